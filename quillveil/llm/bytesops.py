"""Vectorised work on Arrow text columns: buffers, word bounds, word hashes, a word table.

A batch's texts lie in one byte buffer, so words are found and hashed for all
its documents at once. Blocks of a few MB bound the memory whatever the batch
or the longest text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_blocks(off: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about `block` bytes; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + block, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _MULT), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which hashes of spans follow."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomials of byte spans, wherever they lie."""
    sums = prefix_sums(data)
    return (sums[ends] - sums[starts]) * power_tables(len(data) + 1)[1][starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return mix(span_keys(data, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ascii_words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = _ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without the bytes that break words (ASCII white space), and the first word of each row (with one past the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~breaks[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    at = off[(off > 0) & (off < n)]
    opens[at] = solid[at]
    closes[at - 1] = solid[at - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def safe_cuts(data: np.ndarray, block: int, is_cut: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Positions that cut a long text into parts of about `block` bytes, each where `is_cut` allows; a part grows until it does."""
    cuts, at, n = [0], 0, len(data)
    while n - at > block:
        to, step = at + block, block
        while True:
            found = np.flatnonzero(is_cut(data[to : min(n, to + step)]))
            if len(found):
                to += int(found[0])
                break
            to = min(n, to + step)
            if to >= n:
                break
        if to >= n:
            break
        cuts.append(to)
        at = to
    return [*cuts, n]


def _eight(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, those past the size as zeros. The data ends with eight spare bytes."""
    raw = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[at].view("<u8").ravel()
    short = np.minimum(size, 8)
    return np.where(short >= 8, raw, raw & ((np.uint64(1) << (np.uint64(8) * short.astype(np.uint64))) - np.uint64(1)))


class WordTable:
    """Values by word (token ids, or others): an open-addressing table from word hash to a slice of values.

    `entries` gives the entry of each word, and `gather` their values. The
    table is emptied once it holds `capacity` words or `most` values, so its
    memory is bounded whatever the vocabulary. Hashes only find an entry: a word
    is taken for the same if its bytes are.
    """

    def __init__(self, encode: Callable[[list[str]], list], capacity: int = 1_000_000, kind=np.uint32, most: int = 1 << 25):
        self.encode, self.capacity, self.kind, self.most = encode, capacity, kind, most
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Empty the table, with place for so many words if that is more than its capacity."""
        self.mask = (1 << max(10, (2 * max(self.capacity, room) - 1).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.n = self.used = self.text_used = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.head, self.tail, self.size, self.text_at = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.text = np.zeros(8192, self.kind), np.zeros(8192, np.uint8)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where unknown."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        out = self.slot[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            got = self.slot[at[rest]]
            out[rest] = got
            rest = rest[(got >= 0) & (self.keys[at[rest]] != h[rest])]
        return out

    def _add(self, h: np.ndarray, raw: list[bytes]) -> None:
        found = self.encode([x.decode("utf-8", "replace") for x in raw])
        lens = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.frombuffer(b"".join(found), self.kind) if found and isinstance(found[0], bytes) else np.fromiter((i for x in found for i in x), self.kind, int(lens.sum()))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        # Words of up to 16 bytes are known by their first and last eight.
        long = [x if len(x) > 16 else b"" for x in raw]
        n, used, text = self.n + len(raw), self.used + len(flat), b"".join(long)
        if n > len(self.start):
            grown = lambda x: np.resize(x, max(n, 2 * len(x)))
            self.start, self.length, self.head, self.tail, self.size, self.text_at = map(grown, (self.start, self.length, self.head, self.tail, self.size, self.text_at))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        if self.text_used + len(text) > len(self.text):
            self.text = np.resize(self.text, max(self.text_used + len(text), 2 * len(self.text)))
        new = slice(self.n, n)
        self.ids[self.used : used] = flat
        self.length[new] = lens
        self.start[new] = self.used + np.cumsum(lens, dtype=np.int64) - lens
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        begin = np.cumsum(size) - size
        self.head[new], self.tail[new], self.size[new] = _eight(data, begin, size), _eight(data, begin + np.maximum(size - 8, 0), size), size
        kept = np.fromiter(map(len, long), np.int64, len(long))
        self.text_at[new] = self.text_used + np.cumsum(kept) - kept
        self.text[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        for i, key in enumerate(h.tolist()):
            at = key & self.mask
            while self.slot[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.slot[at] = key, self.n + i
        self.n, self.used, self.text_used = n, used, self.text_used + len(text)

    def _fill(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entry of each hash; the first word of each unknown one is encoded and added."""
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            pick = miss[first]
            self._add(new, [data[a:b].tobytes() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
            at[miss] = self._find(h[miss])
        return at

    def _others(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Which words are not those of their entries."""
        differ = (self.size[at] != size) | (self.head[at] != head) | (self.tail[at] != tail)
        long = np.flatnonzero((size > 16) & ~differ)
        for lo in range(0, len(long), 1 << 14):
            i = long[lo : lo + (1 << 14)]
            n = size[i]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = data[np.repeat(starts[i], n) + step] != self.text[np.repeat(self.text_at[at[i]], n) + step]
            differ[i] = np.logical_or.reduceat(other, np.cumsum(n) - n)
        return np.flatnonzero(differ)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entry of each word; unknown words are encoded and added first."""
        unknown = int((self._find(h) < 0).sum())
        if unknown and (self.n + unknown > self.capacity or self.used > self.most) and (self.n or unknown > self.capacity):
            # More words than the table holds: until it is cleared again, it is as large as this block asks for.
            self.clear(len(np.unique(h)))
        at = self._fill(data, starts, ends, h)
        size, spare = ends - starts, np.concatenate((data, np.zeros(8, np.uint8)))
        head, tail = _eight(spare, starts, size), _eight(spare, starts + np.maximum(size - 8, 0), size)
        rest = self._others(at, data, starts, size, head, tail)
        while len(rest):  # words whose hashes clash get other hashes
            h = h.copy()
            h[rest] = mix(h[rest] + np.uint64(1))
            at[rest] = self._fill(data, starts[rest], ends[rest], h[rest])
            rest = rest[self._others(at[rest], data, starts[rest], size[rest], head[rest], tail[rest])]
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of these entries in order, and the number of values of each."""
        lens = self.length[at].astype(np.int64)
        total = int(lens.sum())
        shift = self.start[at] - (np.cumsum(lens) - lens)
        return self.ids[np.repeat(shift, lens) + np.arange(total)], lens


def release_memory() -> None:
    """Give freed memory back to the system; workers are reused, and executors' memory is shared with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def tidy(run: Callable, keeps_encoders: bool = False) -> Callable:
    """The same function over batches, which releases memory when its task ends.

    A worker serves stage after stage; one that needs no tokenizer first drops
    those that an earlier stage left.
    """

    def wrapped(batches):
        if not keeps_encoders and (held := sys.modules.get("quillveil.llm.tokenizing")):
            held._cached.clear()
            release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def bounded_batches(spark, most: int = 8 << 20) -> None:
    """Let Spark send at most so many bytes in an Arrow batch (a longer row alone), however long the texts; never raises the setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, block: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `block` bytes of text, gathered from small batches or cut from large ones."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        off = buffers(b.column(b.schema.get_field_index(column)))[1]
        for lo, hi in row_blocks(off, block):
            held.append(b.slice(lo, hi - lo))
            size += int(off[hi] - off[lo])
            if size >= block:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()
