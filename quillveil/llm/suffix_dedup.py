"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier
(smaller document id, or earlier in the same document). So suffixes matter only
up to LENGTH bytes, and only those whose first LENGTH bytes occur twice.

1. Buckets. Every string of LENGTH bytes has an anchor: the GRAM-byte string in
   it with the smallest hash, the leftmost on ties. Equal strings have equal
   anchors at the same place, so the anchor's hash is the suffix bucket. Runs of
   neighbouring suffixes with one anchor form a segment of at most 2 * LENGTH
   bytes.
2. Scan. In each block of input, of segments that are equal byte by byte the
   earliest goes on, and all suffixes of the others repeat; so again before a
   group of buckets is sorted. This combines before the shuffle, so a passage that a third of all documents share reaches its
   bucket once per block. What moves is the place of a segment and its bucket's
   hash, without bytes; buckets with a single segment are done.
3. Sort. Bytes of the segments of all other buckets are fetched, and one group of
   buckets at a time is sorted: suffixes by their first PERIOD bytes, and longer
   ties by ranks of the difference-cover sample, worked out beforehand for the
   group by prefix doubling. Segments are laid out with their anchors at equal
   residues, so one cover offset per residue serves all ties of a bucket.
4. Large buckets, with more than HOT different segments in a block of input or
   more than MANY in all, are split before they are sorted: by the whole string
   in place of its anchor, after a block's equal strings are combined. Each
   suffix of theirs is a segment of its own, sorted like the others.
5. Spans are merged per document and cut out.

Hashes only choose what meets: every string is found to repeat by its bytes.

Defined results: a null text is empty and stays as it is; texts under LENGTH
bytes lose nothing; rows that repeat both id and text are one document and get
the same result; rows that repeat an id with other text are ordered by a hash
of the text; a null id comes before all others; a long text is scanned in
parts, whatever its length; an empty table gives no row; columns that are not
needed pass through `remove_repeats` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches, buffers, mix, release_memory, row_blocks, text_blocks, tidy
from quillveil.session import materialize, partitions_for

LENGTH = 100
GRAM = 24
PERIOD = 16
HOT = 64
MANY = 4096
BUCKET_BYTES = 16 << 20
GROUP_BYTES = 8 << 20
_CHUNK = 1 << 19
_PART = 1 << 18
_BLOCK = 4 << 20
_SPREAD = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 21) - 1)
#: What a row of intermediate results holds.
COVERED, ANCHORS, SPLIT_REQUEST, REQUEST, SEGMENTS = range(5)


# Columns of arrays in one compressed value ------------------------------------------------------------------------


# A worker is one thread; making a compressor for each value takes longer than most values' compression.
_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _freeze(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths, as one compressed byte string."""
    head = struct.pack(f"<{2 * len(arrays) + 1}q", len(arrays), *[v for a in arrays for v in (ord(a.dtype.char), len(a))])
    return _zip.compress(head + b"".join([a.tobytes() for a in arrays]))


def _thaw(data: bytes) -> list[np.ndarray]:
    raw = _unzip.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


class Docs:
    """Documents by number: id, tie-break, and bucket of each."""

    def __init__(self, k: np.ndarray, t: np.ndarray, group: np.ndarray):
        self.k, self.t, self.group = k, t, group
        self._ranks: np.ndarray | None = None

    def ranks(self) -> np.ndarray:
        """Order by id and tie-break; equal documents share a rank."""
        if self._ranks is None:
            order = np.lexsort((self.t, self.k))
            k, t = self.k[order], self.t[order]
            new = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (t[1:] != t[:-1]))))
            self._ranks = np.empty(len(order), np.int64)
            self._ranks[order] = new[: len(order)]
        return self._ranks

    @staticmethod
    def concat(parts: list[Docs]) -> Docs:
        return Docs(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("k", "t", "group")])


def _by(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Value and positions of each group of equal values, positions ascending."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(values[part[0]]), part


def _packs(by: np.ndarray, docs: Docs, doc: np.ndarray, start: np.ndarray, *fields: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each value of `by`, its rows in order of document and start, packed with the documents that they need: value, positions, bytes.

    All groups are sorted and numbered at once, as most hold few rows.
    """
    order = np.lexsort((start, doc, by))
    if not len(order):
        return
    by, doc = by[order], doc[order]
    new = np.concatenate(([True], by[1:] != by[:-1]))
    used = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    of = doc[used]
    k, t, group, step = docs.k[of], docs.t[of], docs.group[of], (used & ~new).astype("u1")
    before = np.concatenate(([0], k[:-1]))
    before[new[used]] = 0
    k, rows = k - before, [start[order], *[f[order] for f in fields]]
    cuts, heads = [*np.flatnonzero(new).tolist(), len(order)], [*np.flatnonzero(new[used]).tolist(), len(of)]
    for value, lo, hi, a, b in zip(by[cuts[:-1]].tolist(), cuts, cuts[1:], heads, heads[1:], strict=False):
        yield value, order[lo:hi], _freeze(k[a:b], t[a:b], group[a:b], step[lo:hi], *[r[lo:hi] for r in rows])


def _unpack(values: list[bytes]) -> tuple[Docs, np.ndarray, list[np.ndarray]]:
    parts, docs, base, numbers = [_thaw(v) for v in values], [], 0, []
    for p in parts:
        docs.append(Docs(np.cumsum(p[0]), p[1], p[2]))
        numbers.append(np.cumsum(p[3], dtype=np.int64) + base)
        base += len(p[0])
    return Docs.concat(docs), np.concatenate(numbers), [np.concatenate([p[i] for p in parts]) for i in range(4, len(parts[0]))]


def _spans(docs: Docs, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Covered spans by document group."""
    for group, _, data in _packs(docs.group[doc], docs, doc, start.astype("<u4"), size.astype("<u4")):
        yield group, data


# Anchors ----------------------------------------------------------------------------------------------------------


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all substrings of GRAM and of 64 bytes."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h, size, grams = data.astype(np.uint64) + np.uint64(0x51ED270B), 1, None
    while size < 64:
        longer = h[:-size] * power(size) + h[size:]
        if size == 8:  # GRAM is 8 and 16
            grams = longer[: len(h) - 16] * power(8) + h[16:]
        h, size = longer, 2 * size
    return grams, h


def _string_hashes(h64: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of strings of 64 to 192 bytes, from three of 64 bytes that cover them."""
    out = mix(h64[start] + size.astype(np.uint64))
    for at in (start + (size - 64) // 2, start + size - 64):
        out = mix((out ^ h64[at]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return out


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts in one buffer, whose ends are given by position: start, suffixes, anchor's offset, bucket hash, content hash."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams, h64 = _hashes(data)
    grams = mix(grams)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= _SPREAD:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (_SPREAD - size)], low[_SPREAD - size :])
    suffix = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[: len(low)])
    place = (low[suffix] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(suffix) != 1)))[: len(suffix)]
    first = np.flatnonzero(new)
    start, count, anchor = suffix[first], np.diff(np.append(first, len(suffix))), place[first]
    offset = anchor - start
    content = _string_hashes(h64, start, count + LENGTH - 1) ^ mix(offset.astype(np.uint64))
    return start, count, offset, grams[anchor], content


def _text_anchors(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start in its text, suffixes, anchor's offset, bucket hash, content hash: for blocks of texts, and for parts of long ones."""
    for lo, hi in row_blocks(off, _PART):
        a, b = int(off[lo]), int(off[hi])
        if b - a <= _PART:
            part = data[a:b]
            start, *rest = _anchors(part, np.repeat(off[lo + 1 : hi + 1] - a, np.diff(off[lo : hi + 1])))
            row = np.searchsorted(off[lo : hi + 1] - a, start, "right") - 1
            yield row + lo, start - (off[row + lo] - a), *rest
            continue
        for x in range(a, b, _PART):
            part = data[x : min(b, x + _PART + LENGTH - 1)]
            start, *rest = _anchors(part, np.full(len(part), len(part)))
            yield np.full(len(start), lo), start + (x - a), *rest


def _equal(data: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether strings at these places have the same bytes."""
    out = size_a == size_b
    for lo in range(0, len(a), 1 << 12):
        at = lo + np.flatnonzero(out[lo : lo + (1 << 12)])
        if len(at):
            n = size_a[at]
            other = data[_ranges(a[at], n)] != data[_ranges(b[at], n)]
            out[at] = np.add.reduceat(other, np.cumsum(n) - n) == 0
    return out


def _settle(docs: Docs, doc, start, data, at, size, bucket, content):
    """Of equal strings the earliest stays: which stay, how many different ones their bucket has, and which repeat. `at`: their places in the data."""
    rank = docs.ranks()[doc]
    order = np.lexsort((start, rank, content, bucket))
    b, c, r, s = bucket[order], content[order], rank[order], start[order]
    new_b = np.concatenate(([True], b[1:] != b[:-1]))[: len(b)]
    new = new_b | np.concatenate(([True], c[1:] != c[:-1]))[: len(b)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
    later = ~new & ((r != r[head]) | (s != s[head]))
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_b)) if len(b) else np.zeros(0, np.int64)
    per_row = kinds[np.cumsum(new_b) - 1]
    first, repeat = order[head[later]], order[later]
    same = _equal(data, at[repeat], size[repeat], at[first], size[first])
    # Hashes that agree on different bytes only cost a place in the sort.
    return np.concatenate((order[new], repeat[~same])), np.concatenate((per_row[new], per_row[later][~same])), repeat[same]


def _emit(bucket, kind, group, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(group, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "group", "data"])


_ROWS = "bucket bigint, kind int, group bigint, data binary"


def _batch_docs(b: pa.RecordBatch | pa.Table) -> Docs:
    col = lambda n: b.column(n).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(n).to_numpy()
    return Docs(col("_sd_k").astype("<i8"), col("_sd_t").astype("<i8"), col("_sd_g").astype("<i8"))


def _scan(n_buckets: int):
    """Step 1 and the first half of 2, for each batch of documents."""

    def settle(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = _batch_docs(b)
        data, off = buffers(b.column(b.schema.get_field_index("_sd_x")))
        found = list(_text_anchors(data, off))
        if not found:
            return
        doc, start, count, offset, bucket, content = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not len(doc):
            return
        stay, kinds, later = _settle(docs, doc, start, data, off[doc] + start, count + LENGTH - 1, bucket, content)
        rows: list[tuple] = [(g, COVERED, g, d) for g, d in _spans(docs, doc[later], start[later], count[later] + LENGTH - 1)]
        is_hot = kinds > HOT
        rows += _requests(docs, stay[is_hot], doc, start, count, offset, bucket, SPLIT_REQUEST)
        # One row of a large bucket goes on as a mark: its suffix count is 0.
        _, mark = np.unique(bucket[stay[is_hot]], return_index=True)
        keep = np.concatenate((stay[~is_hot], stay[is_hot][mark]))
        n = count.copy()
        n[stay[is_hot][mark]] = 0
        of = (bucket[keep] % np.uint64(n_buckets)).astype(np.int64)
        rows += [(k, ANCHORS, 0, d) for k, _, d in _packs(of, docs, doc[keep], start[keep].astype("<u4"), n[keep].astype("u1"), offset[keep].astype("u1"), bucket[keep])]
        yield _emit(*zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "_sd_x", _BLOCK):
            yield from settle(b)

    return run


def _requests(docs: Docs, at: np.ndarray, doc, start, count, offset, bucket, kind: int) -> list[tuple]:
    """Segments whose bytes are asked for, by document group."""
    d = doc[at]
    return [(g, kind, g, data) for g, _, data in _packs(docs.group[d], docs, d, start[at].astype("<u4"), count[at].astype("u1"), offset[at].astype("u1"), bucket[at])]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]], list[tuple]]]:
    """Rows of one bucket at a time from a partition sorted by bucket: number, data by kind, and the rows that only pass."""
    now, held, passing = None, {}, []
    for b in batches:
        for bucket, kind, group, data in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            if bucket != now:
                if held or passing:
                    yield now, held, passing
                now, held, passing = bucket, {}, []
            if kind in (COVERED, SPLIT_REQUEST):
                passing.append((bucket, kind, group, data))
            else:
                held.setdefault(kind, []).append(data)
    if held or passing:
        yield now, held, passing


def _merge(values: list[bytes]) -> list[tuple]:
    """What the sort needs of one bucket of the hash space: the segments whose anchor has others."""
    docs, doc, (start, count, offset, bucket) = _unpack(values)
    start, count, offset = start.astype(np.int64), count.astype(np.int64), offset.astype(np.int64)
    rank = docs.ranks()[doc]
    order = np.lexsort((start, rank, bucket))
    b, r, s = bucket[order], rank[order], start[order]
    new_b = np.concatenate(([True], b[1:] != b[:-1]))[: len(b)]
    real = count[order] > 0
    # Rows that repeat id and text are one document.
    again = np.concatenate(([False], (b[1:] == b[:-1]) & (r[1:] == r[:-1]) & (s[1:] == s[:-1]) & real[:-1]))[: len(b)]
    first = np.flatnonzero(new_b)
    marked = np.add.reduceat((~real).astype(np.int64), first)[np.cumsum(new_b) - 1] > 0
    n = np.add.reduceat((real & ~again).astype(np.int64), first)[np.cumsum(new_b) - 1]
    split = real & ~again & (marked | (n > MANY))
    whole = real & ~again & ~split & (n > 1)
    return _requests(docs, order[split], doc, start, count, offset, bucket, SPLIT_REQUEST) + _requests(docs, order[whole], doc, start, count, offset, bucket, REQUEST)


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held, passing in _buckets(batches):
        rows = passing + (_merge(held[ANCHORS]) if ANCHORS in held else [])
        if rows:
            yield _emit(*zip(*rows, strict=True))


# Bytes of segments ------------------------------------------------------------------------------------------------


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    shift = start - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(int(size.sum()))


def _locate(docs: Docs, wanted: Docs) -> np.ndarray:
    """A row of `docs` for each wanted document."""
    key = {x: i for i, x in enumerate(zip(docs.k.tolist(), docs.t.tolist(), strict=True))}
    return np.array([key[x] for x in zip(wanted.k.tolist(), wanted.t.tolist(), strict=True)], np.int64)


def _with_bytes(head: bytes, text: np.ndarray) -> bytes:
    """Packed rows and their bytes as one value."""
    return len(head).to_bytes(8, "little") + head + _zip.compress(text.tobytes())


def _fetch(n_buckets: int):
    """Cut the bytes that are asked for out of a group of documents: segments, and single suffixes of large buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if right.num_rows and left.num_rows:
            docs = _batch_docs(left)
            data, off = buffers(left.column("_sd_x"))
            kinds = np.array(right.column("kind").to_pylist())
            values = right.column("data").to_pylist()
            for kind in (REQUEST, SPLIT_REQUEST):
                if not (kinds == kind).any():
                    continue
                wanted, doc, (start, count, offset, bucket) = _unpack([values[i] for i in np.flatnonzero(kinds == kind)])
                row = _locate(docs, wanted)[doc]
                start, count = start.astype(np.int64), count.astype(np.int64)
                at = off[row] + start
                if kind == REQUEST:
                    of = (bucket % np.uint64(n_buckets)).astype(np.int64)
                    for k, i, head in _packs(of, docs, row, start.astype("<u4"), count.astype("u1"), offset.astype("u1"), bucket):
                        text = data[_ranges(at[i], count[i] + LENGTH - 1)]
                        rows.append((k, SEGMENTS, 0, _with_bytes(head, text)))
                    continue
                for lo in range(0, len(at), 1 << 12):
                    i = slice(lo, lo + (1 << 12))
                    size = count[i] + LENGTH - 1
                    text = data[_ranges(at[i], size)]
                    h64 = _hashes(text)[1]
                    pos = _ranges(np.cumsum(size) - size, count[i])
                    full = np.full(len(pos), LENGTH)
                    one = _string_hashes(h64, pos, full)
                    two = mix(h64[pos] * np.uint64(3) ^ mix(h64[pos + LENGTH - 64] + np.uint64(7)))
                    d, s = np.repeat(row[i], count[i]), np.repeat(start[i], count[i]) + _ranges(np.zeros(len(size), np.int64), count[i])
                    stay, _, later = _settle(docs, d, s, data, off[d] + s, full, one, two)
                    rows += [(g, COVERED, g, x) for g, x in _spans(docs, d[later], s[later], full[later])]
                    d, s, of = d[stay], s[stay], (one[stay] % np.uint64(n_buckets)).astype(np.int64)
                    for k, j, head in _packs(of, docs, d, s.astype("<u4"), np.ones(len(d), "u1"), np.zeros(len(d), "u1"), one[stay]):
                        text = data[_ranges(off[d[j]] + s[j], np.full(len(j), LENGTH))]
                        rows.append((k, SEGMENTS, 0, _with_bytes(head, text)))
        release_memory()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["bucket", "kind", "group", "data"])

    return run


# Suffix sorting ---------------------------------------------------------------------------------------------------


def difference_cover(period: int) -> list[int]:
    """Residues such that any two positions have a common shift below `period` that takes both to residues of the cover (greedy)."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: len({d % period for c in cover for d in (r - c, c - r)} & missing)
        best = max(range(period), key=lambda r: (gain(r), -r))
        missing -= {d % period for c in cover for d in (best - c, c - best)}
        cover.append(best)
    return sorted(cover)


def _dense(key: np.ndarray) -> np.ndarray:
    """Dense ranks of one key."""
    order = np.argsort(key)
    values = key[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], values[1:] != values[:-1]))[: len(order)])
    return out


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by several keys, the first most significant. Keys of few bits are sorted as one number, together with the row's."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    rank, bits, place = None, 0, max(1, (n - 1).bit_length())
    for k in keys:
        low, size = (int(k.min()), (int(k.max()) - int(k.min())).bit_length()) if k.dtype.kind == "i" else (0, 64)
        if size > place + 1:
            k, low, size = _dense(k), 0, place
        k = (k - low).astype(np.uint64)
        if rank is not None and bits + size > 64:
            rank, bits = _dense(rank).astype(np.uint64), place
        rank, bits = k if rank is None else rank << np.uint64(size) | k, bits + size
    if bits + place > 64:
        return _dense(rank)
    rank = np.sort(rank << np.uint64(place) | np.arange(n, dtype=np.uint64))
    order = (rank & np.uint64((1 << place) - 1)).astype(np.int64)
    rank >>= np.uint64(place)
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.concatenate(([False], rank[1:] != rank[:-1])))
    return out


class CoverRanks:
    """Ranks, among the positions of a difference cover, of the strings of `reach` bytes from there, by prefix doubling."""

    def __init__(self, text: np.ndarray, period: int = PERIOD, reach: int = 80):
        self.cover = np.array(difference_cover(period))
        self.words = x = text.astype(np.uint64)
        for size in (1, 2, 4):
            y = np.zeros_like(x)
            y[:-size] = x[size:]
            x = (x << np.uint64(8 * size)) | y
        self.words = x
        n = len(text)
        at = np.flatnonzero(np.isin(np.arange(n) % period, self.cover))
        number = np.full(n + 1, -1, np.int64)
        number[at] = np.arange(len(at))
        follow = lambda rank, by: np.where(at + by < n, rank[number[np.minimum(at + by, n)]], -1)
        first = _rank(x[at], np.where(at + 8 < n, x[np.minimum(at + 8, n - 1)], np.uint64(0)))
        rank, size = first, 16
        while 2 * size <= reach:
            rank = _rank(rank, follow(rank, size))
            size *= 2
        while size < reach:
            rank = _rank(rank, follow(first, size))
            size += 16
        self.number, self.rank, self.reach = number, rank, size
        self.shift = np.array([next(d for d in range(period) if (r + d) % period in set(self.cover.tolist())) for r in range(period)])


def _sort_segments(docs: Docs, doc, start, count, offset, bucket, text) -> tuple[np.ndarray, np.ndarray]:
    """Step 3 for some buckets: the suffixes whose string occurs earlier, as segment number and suffix number in it."""
    size = count + LENGTH - 1
    # Anchors at multiples of PERIOD.
    room = (np.maximum(offset, 0) + size + 2 * PERIOD) // PERIOD * PERIOD + PERIOD
    base = np.cumsum(room) - room
    base = base + (-(base + offset)) % PERIOD
    buffer = np.zeros(int(room.sum()) + 2 * LENGTH, np.uint8)
    buffer[_ranges(base, size)] = text
    ranks = CoverRanks(buffer)
    words = ranks.words
    segment = np.repeat(np.arange(len(count)), count)
    at = _ranges(base, count)
    name = _rank(bucket)[segment]
    residue = at % PERIOD
    # Suffixes of each bucket by their first PERIOD bytes; those alone with them are done.
    tie = _rank(name, words[at], words[at + 8], residue)
    many = np.flatnonzero(np.bincount(tie)[tie] > 1)
    if not len(many):
        return segment[many], many
    a = at[many]
    cover = ranks.rank[ranks.number[a + ranks.shift[residue[many]]]]
    tail = LENGTH - 24
    who = docs.ranks()[doc][segment[many]]
    place = start[segment[many]] + (a - base[segment[many]])
    same = _rank(tie[many], cover, words[a + tail], words[a + tail + 8], words[a + tail + 16])
    # Of equal strings the first in order of document and start stays.
    who = who << 32 | place
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, who)
    later = who != least[same]
    hit = many[later]
    return segment[hit], at[hit] - base[segment[hit]]


def _may_repeat(h64: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes at these places may have an equal one among them: all that have one, and those whose hash agrees with another's."""
    n, place = len(pos), np.uint64(max(1, (len(pos) - 1).bit_length()))
    key = mix(h64[pos] * np.uint64(3) ^ mix(h64[pos + LENGTH - 64] + np.uint64(7)))
    # A hash and its row in one number, so that numbers alone are sorted.
    key = np.sort(key >> place << place | np.arange(n, dtype=np.uint64))
    same = key[1:] >> place == key[:-1] >> place
    row = (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    out = np.zeros(n, bool)
    out[row[1:][same]] = out[row[:-1][same]] = True
    return out


def _sort_bucket(values: list[bytes]) -> list[tuple]:
    """Sort the segments of a bucket of the hash space, some anchors at a time."""
    heads, texts = [], []
    for v in values:
        n = int.from_bytes(v[:8], "little")
        heads.append(v[8 : 8 + n])
        texts.append(np.frombuffer(_unzip.decompress(v[8 + n :]), np.uint8))
    docs, doc, (start, count, offset, bucket) = _unpack(heads)
    text = np.concatenate(texts)
    start, count, offset = start.astype(np.int64), count.astype(np.int64), offset.astype(np.int64)
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.argsort(bucket, kind="stable")
    sums = np.cumsum(size[order])
    last = np.append(np.flatnonzero(np.diff(bucket[order])), len(order) - 1)  # last of each anchor
    # Document, start and size of what repeats, over all parts: a row for each part and document group would be more rows the more groups there are.
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(order):
        done = sums[lo - 1] if lo else 0
        k = int(np.searchsorted(sums[last], done + _CHUNK, "right"))
        k = max(k - 1, int(np.searchsorted(last, lo)))
        i = order[lo : last[k] + 1]
        lo = int(last[k]) + 1
        part, n = text[_ranges(begin[i], size[i])], size[i]
        place = np.cumsum(n) - n
        # Equal segments first, so that the sort sees different ones only.
        h64 = _hashes(part)[1]
        content = _string_hashes(h64, place, n) ^ mix(offset[i].astype(np.uint64))
        stay, _, later = _settle(docs, doc[i], start[i], part, place, n, bucket[i], content)
        found.append((doc[i[later]], start[i[later]], n[later]))
        stay = np.sort(stay)
        _, group, members = np.unique(bucket[i][stay], return_inverse=True, return_counts=True)
        stay = stay[members[group] > 1]
        if not len(stay):
            continue
        # Of a segment what lies between its first and last suffix that may repeat is sorted.
        many = count[i[stay]]
        at = np.flatnonzero(_may_repeat(h64, _ranges(place[stay], many)))
        if not len(at):
            continue
        ends = np.cumsum(many)
        of = np.searchsorted(ends, at, "right")
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        final = np.append(first[1:], len(at)) - 1
        stay, skip, many = stay[of[first]], at[first] - (ends - many)[of[first]], at[final] - at[first] + 1
        part, i = part[_ranges(place[stay] + skip, many + LENGTH - 1)], i[stay]
        head = start[i] + skip
        seg, suffix = _sort_segments(docs, doc[i], head, many, offset[i] - skip, bucket[i], part)
        if not len(seg):
            continue
        # Neighbouring suffixes of a segment make one span.
        new = np.concatenate(([True], (np.diff(seg) != 0) | (np.diff(suffix) != 1)))
        f = np.flatnonzero(new)
        n = np.diff(np.append(f, len(seg)))
        found.append((doc[i[seg[f]]], head[seg[f]] + suffix[f], n + LENGTH - 1))
    return [(g, COVERED, g, x) for g, x in _spans(docs, *[np.concatenate(x) for x in zip(*found, strict=True)])] if found else []


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held, passing in _buckets(batches):
        rows = list(passing)
        if SEGMENTS in held:
            rows += _sort_bucket(held[SEGMENTS])
        if rows:
            yield _emit(*zip(*rows, strict=True))


# Result -----------------------------------------------------------------------------------------------------------


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of positions that these spans cover; spans that touch are one."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))[: len(s)]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s))[: len(first)] - 1] if len(first) else e


def _cut(names: list[str] | None, text_at: str | None):
    """Cut the spans out of a group of documents: digests, or the rows with their new text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = _batch_docs(left)
        data, off = buffers(left.column("_sd_x"))
        by_row: dict[int, np.ndarray] = {}
        spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * left.num_rows
        if right.num_rows and left.num_rows:
            wanted, doc, (start, size) = _unpack(right.column("data").to_pylist())
            by_row = {int(n): at for n, at in _by(_first(wanted)[doc])}
            number = {x: i for i, x in enumerate(zip(wanted.k.tolist(), wanted.t.tolist(), strict=True))}
            # `_first` numbers equal documents by their last place, as this dictionary does.
            for i, key in enumerate(zip(docs.k.tolist(), docs.t.tolist(), strict=True)):
                at = by_row.get(number.get(key, -1))
                if at is not None:
                    s = start[at].astype(np.int64)
                    spans[i] = _union(s, s + size[at])
        kept, removed = [], []
        for i, (s, e) in enumerate(spans):
            raw = data[off[i] : off[i + 1]]
            if len(s):
                raw = np.concatenate([raw[x:y] for x, y in zip(np.concatenate(([0], e)), np.append(s, len(raw)), strict=True)])
            kept.append(raw.tobytes())
            removed.append(int((e - s).sum()))
        if names is None:
            return pa.table(
                [left.column("_sd_id"), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s, _ in spans], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )
        absent = left.column("_sd_n").to_pylist()
        texts = pa.array([None if gone else x.decode("utf-8", "ignore") for gone, x in zip(absent, kept, strict=True)], pa.string())
        return pa.table([texts if n == text_at else left.column(n) for n in names], names=names)

    return run


def _first(docs: Docs) -> np.ndarray:
    """One number for equal documents: the last that is equal."""
    last = {x: i for i, x in enumerate(zip(docs.k.tolist(), docs.t.tolist(), strict=True))}
    return np.array([last[x] for x in zip(docs.k.tolist(), docs.t.tolist(), strict=True)], np.int64)


def _repeats(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents with working columns and those to keep, and the covered spans; both with their document group.

    Both users of the documents group them by the same column, so one shuffle of the texts serves them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets, n_groups = max(16, total // BUCKET_BYTES), max(16, total // GROUP_BYTES)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    group = F.pmod(F.xxhash64(key, F.xxhash64(text)), F.lit(n_groups))
    named = docs.select(*keep, F.col(id_col).cast("long").alias("_sd_id"), key.alias("_sd_k"), F.xxhash64(text).alias("_sd_t"), group.alias("_sd_g"), text.alias("_sd_x"), F.col(text_col).isNull().alias("_sd_n"))
    parts = partitions_for(docs)
    bounded_batches(docs.sparkSession)
    found = named.select("_sd_k", "_sd_t", "_sd_g", "_sd_x").mapInArrow(tidy(_scan(n_buckets)), _ROWS)
    merged = materialize(found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_merge_buckets), _ROWS), "suffix-merged")
    asked = merged.filter(F.col("kind") != COVERED).select("group", "kind", "data")
    bytes_of = named.groupBy("_sd_g").cogroup(asked.groupBy("group")).applyInArrow(_fetch(n_buckets), _ROWS)
    ordered = bytes_of.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_sort_buckets), _ROWS)
    return named, merged.filter(F.col("kind") == COVERED).unionByName(ordered).select("group", "kind", "data")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    named, covered = _repeats(docs, id_col, text_col, [])
    return named.groupBy("_sd_g").cogroup(covered.groupBy("group")).applyInArrow(_cut(None, None), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their repeated strings cut out of the text (a character that is cut through goes)."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    number = {n: f"c{i}" for i, n in enumerate(names)}
    text_at = number[text_col]
    named, covered = _repeats(safe, number[id_col], text_at, [c for c in safe.columns if c != text_at])
    out = named.groupBy("_sd_g").cogroup(covered.groupBy("group")).applyInArrow(_cut(safe.columns, text_at), safe.schema)
    return out.toDF(*names)
