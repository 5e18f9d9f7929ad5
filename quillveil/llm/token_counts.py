"""Exact token counts of every prefix, by dynamic programming, stored and asked.

`PrefixCounter.prefix_steps` is the programme: the encoding of a prefix that
ends in piece t is the encoding of the prefix before t, followed by t, and t is
the only piece ending there that merges leave alone next to the one before it.
So count[i] = count[i - len(t)] + 1, with one look-back per piece that ends at
i. Merges never cross a segment's start (see `tokenizing.PieceBpe`), so the
programme runs once per distinct segment, and the counts of a text are those of
its segments, added up.

`prefix_tables` stores the count at every prefix of every text: one byte per
byte of text, the step from the prefix before (at the first byte of a
character; merges make some steps negative), compressed. `count_at`,
`longest_within` and `ask_tables` answer from that table alone, without text,
model or encoder. `count_tokens` writes the tables and asks them.

Defined results: a null text counts as empty; an empty text has no tokens;
texts of any length are worked on in blocks; repeated rows and ids give a row
each; an empty table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import BLOCK, WordTable, bounded_batches, buffers, tidy
from quillveil.llm.tokenizing import PieceBpe, cached
from quillveil.session import materialize

LIMIT = 4096
_OUT_BYTES = 4 << 20


class PrefixCounter:
    """Prefix counts of texts, for one model."""

    def __init__(self, path: str):
        self.pieces = cached(PieceBpe, path)
        self.sp = self.pieces.sp
        self.ids = {self.sp.id_to_piece(i): i for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))}
        self.longest = max(map(len, self.ids))
        if self.longest > 120:
            raise ValueError("steps of this model do not fit into a byte")
        self.sound: dict[tuple[str, str], bool] = {}
        self.table = WordTable(lambda segments: [self.prefix_steps(x) for x in segments], kind=np.int8)

    def _stable(self, left: str, right: str) -> bool:
        """Whether merges leave these two pieces apart when they stand side by side."""
        key = (left, right)
        if key not in self.sound:
            if len(self.sound) > 1_000_000:
                self.sound.clear()
            raw = (left + right).replace(PieceBpe.BLANK, " ")
            ids = self.sp.encode("\n" + raw)[len(self.pieces.head) :]
            self.sound[key] = ids == ([self.ids[left]] if left else []) + [self.ids[right]]
        return self.sound[key]

    def prefix_steps(self, segment: str) -> bytes:
        """For each byte of a segment the step (signed) of the prefix count with its character, at the first byte of that."""
        text = segment.replace(" ", PieceBpe.BLANK)
        counts, last, steps = [0], [""], bytearray()  # of the last prefixes that a piece can reach back to
        for i, c in enumerate(text, 1):
            for k in range(min(self.longest, i), 0, -1):
                piece = text[i - k : i]
                if piece in self.ids and self._stable(last[-k], piece):
                    now, end = counts[-k] + 1, piece
                    break
            else:
                # No piece: the character falls back to bytes, which no merge crosses.
                now, end = counts[-1] + len(c.encode("utf-8", "replace")), ""
            steps.append((now - counts[-1]) & 0xFF)
            steps += bytes(len(segment[i - 1].encode("utf-8", "replace")) - 1)
            counts.append(now)
            last.append(end)
            if len(counts) > 4 * self.longest:
                counts, last = counts[-self.longest :], last[-self.longest :]
        return bytes(steps)

    def steps(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Row and the steps at all its bytes, row after row."""
        held: list[np.ndarray] = []
        for lo, hi, _, _, _, first, at, more in self.pieces.blocks(data, off, self.table):
            steps, lens = self.table.gather(at)
            if more or held:
                held.append(steps)
                if not more:
                    yield lo, _without_dummy(np.concatenate(held))
                    held = []
                continue
            ends = np.concatenate(([0], np.cumsum(lens)))[first].tolist()
            for i in range(hi - lo):
                yield lo + i, _without_dummy(steps[ends[i] : ends[i + 1]])

    def stored(self, text: str | None) -> bytes:
        """The table of one text."""
        data, off = buffers(pa.array([text], pa.large_string()))
        return _stored(next(s for _, s in self.steps(data, off)))


def _without_dummy(steps: np.ndarray) -> np.ndarray:
    """Steps of the text itself: that of the blank before it comes with its first character."""
    if not len(steps):
        return steps
    out = steps[1:].copy()
    out[0] += steps[0]
    return out


def _stored(steps: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes())


def _counts(table: bytes) -> Iterator[np.ndarray]:
    """Counts at every byte of a stored table, in blocks."""
    steps, now = np.frombuffer(zstandard.ZstdDecompressor().decompress(table), np.int8), 0
    for lo in range(0, len(steps), BLOCK):
        counts = np.cumsum(steps[lo : lo + BLOCK], dtype=np.int64) + now
        now = int(counts[-1])
        yield counts


def count_at(table: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of so many bytes (inside a character: with that character)."""
    last = 0
    for counts in _counts(table):
        if n_bytes <= 0:
            break
        last = int(counts[min(n_bytes, len(counts)) - 1])
        n_bytes -= len(counts)
    return last


def longest_within(table: bytes, budget: int) -> int:
    """Bytes of the longest prefix whose own encoding has at most `budget` tokens."""
    best, base = 0, 0
    for counts in _counts(table):
        fits = np.flatnonzero(counts <= budget)
        if len(fits):
            best = base + int(fits[-1]) + 1
        base += len(counts)
    return best


def prefix_tables(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tables to store: id, n_bytes, prefix_steps (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached(PrefixCounter, model_path)

        def out(b: pa.RecordBatch, size: np.ndarray, first: int, held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.array(size[first : first + len(held)]), pa.array(held, pa.binary())], names=[id_col, "n_bytes", "prefix_steps"])

        for b in batches:
            data, off = buffers(b.column(1))
            size, held, first, n = np.diff(off), [], 0, 0
            for i, steps in counter.steps(data, off):
                held.append(_stored(steps))
                n += len(held[-1])
                if n > _OUT_BYTES:
                    yield out(b, size, first, held)
                    held, first, n = [], i + 1, 0
            if held:
                yield out(b, size, first, held)

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(tidy(run, True), f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes bigint, prefix_steps binary")


def ask_tables(tables: DataFrame, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, limit_bytes (of the longest prefix within the limit), half_tokens (of the first half of its bytes): from the tables alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rows = b.column(1).to_numpy(), []
            for n, value in zip(size.tolist(), b.column(2), strict=True):
                table = value.as_py()
                rows.append((count_at(table, n), longest_within(table, limit), count_at(table, n // 2)))
            total, within, half = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(total > limit), pa.array(within), pa.array(half)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "limit_bytes", "half_tokens"])

    return tables.select(id_col, "n_bytes", "prefix_steps").mapInArrow(tidy(run, True), f"{id_col} {dict(tables.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_bytes bigint, half_tokens bigint")


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, from tables stored in the shared folder: see `ask_tables`."""
    return ask_tables(materialize(prefix_tables(docs, model_path, id_col, text_col), "prefix-tables"), limit, id_col)
