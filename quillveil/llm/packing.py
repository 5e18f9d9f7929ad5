"""Hierarchical packing of tokenized documents into windows of several lengths.

Each scan task tokenizes its documents and packs them at once:

1. Route. A document goes to the tier of the shortest window that holds it;
   a longer one fills whole windows of the largest tier first and its rest is
   routed.
2. Pack each tier. Windows of a tier are filled first-fit from its own queue.
3. Fill gaps. What a longer window has left is filled from the shorter tiers,
   longest first, by cutting one document where none fits; so every window
   that is closed is full.
4. What a task cannot close (less than one window) goes on with its ids, is
   gathered from a bounded number of tasks, packed the same way, and what is
   left then is cut at powers of two, so that it needs no padding.
5. Balance. Windows get a step group, each of `step_tokens` tokens in windows of
   one length, so that the members of a step have equal work.

A task holds at most `queue` documents of a tier, whatever its input. Ids are
unique per task and the scan's splits are deterministic, so a lost task
yields the same windows when it runs again.

Defined results: a null text counts as empty and holds the end id alone;
repeated rows and ids, and rows without id, are packed each; rows are taken as
they come, and what is gathered from several tasks by task, id, place and
content, so ties have one order; long texts are encoded in blocks and cut over
windows; an empty table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches, buffers, tidy
from quillveil.llm.tokenizing import WordBpe, cached
from quillveil.session import materialize

TIERS = (1024, 2048, 4096)
END_ID = 2
QUEUE = 256
GATHER = 32
STEP_TOKENS = 1 << 16
_FIELDS = ("_doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "_ids")


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens) into full windows; `rows` takes what is done."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, queue: int = QUEUE, step_tokens: int = STEP_TOKENS):
        self.tiers, self.base, self.limit, self.step_tokens = tiers, base, queue, step_tokens
        self.queues: dict[int, deque] = {t: deque() for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)
        self.made = 0
        self.windows: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        top = self.tiers[-1]
        while len(ids) >= top:
            self._emit([(doc, start, ids[:top], doc_tokens)], top)
            start, ids = start + top, ids[top:]
        if len(ids):
            self._route((doc, start, ids, doc_tokens))
            for t in self.tiers:
                while len(self.queues[t]) > self.limit and self._close(t):
                    pass

    def _route(self, piece: tuple, front: bool = False) -> None:
        tier = next(t for t in self.tiers if len(piece[2]) <= t)
        (self.queues[tier].appendleft if front else self.queues[tier].append)(piece)
        self.tokens[tier] += len(piece[2])

    def _take(self, tier: int, room: int) -> tuple | None:
        """The first piece of a tier's queue that fits, of its first few."""
        q = self.queues[tier]
        for i, piece in enumerate(q):
            if len(piece[2]) <= room:
                del q[i]
                self.tokens[tier] -= len(piece[2])
                return piece
            if i >= 32:
                break
        return None

    def _close(self, tier: int) -> bool:
        """Fill and emit one window of this tier; false if the tokens up to this tier do not suffice."""
        below = [t for t in self.tiers if t <= tier]
        if sum(self.tokens[t] for t in below) < tier:
            return False
        parts, room = [], tier
        for t in reversed(below):
            while room and (piece := self._take(t, room)):
                parts.append(piece)
                room -= len(piece[2])
        if room:
            # Nothing fits any more: cut the head of the shortest tier that has a piece.
            t = next(t for t in below if self.queues[t])
            doc, start, ids, n = self.queues[t].popleft()
            self.tokens[t] -= len(ids)
            parts.append((doc, start, ids[:room], n))
            self._route((doc, start + room, ids[room:], n), front=True)
        self._emit(parts, tier)
        return True

    def _emit(self, parts: list[tuple], window: int) -> None:
        sequence, at = self.base + self.made, 0
        self.made += 1
        k = self.windows[window] = self.windows.get(window, -1) + 1
        # Groups of one window length, of equal tokens; numbered apart by task and length.
        group = self.base + (k // max(1, self.step_tokens // window)) * 64 + window.bit_length()
        for doc, start, ids, n in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, at, window, group, None))
            at += len(ids)

    def finish(self) -> None:
        """Close every window that can be filled, the longest first."""
        for t in reversed(self.tiers):
            while self._close(t):
                pass

    def left(self) -> list[tuple]:
        """The pieces that no full window took."""
        return [p for t in reversed(self.tiers) for p in self.queues[t]]

    def finish_at_powers(self) -> None:
        """Put all that is left into windows whose lengths are powers of two."""
        rest = deque(self.left())
        for q in self.queues.values():
            q.clear()
        total = sum(len(p[2]) for p in rest)
        while total:
            window = room = min(1 << (total.bit_length() - 1), self.tiers[-1])
            total -= window
            parts = []
            while room:
                doc, start, ids, n = rest.popleft()
                if len(ids) > room:
                    rest.appendleft((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                parts.append((doc, start, ids, n))
                room -= len(ids)
            self._emit(parts, window)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group."""
    id_type = dict(docs.dtypes)[id_col]
    if sorted(tiers) != list(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two")
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    kinds = f"_doc {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step_group bigint, _ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached(WordBpe, tokenizer_path)
        task = TaskContext.get().partitionId()
        packer = Packer(task << 32, tiers)
        tail, schema = np.array([end_id], "<u4"), None
        for b in batches:
            schema = schema or pa.schema(list(zip(_FIELDS, [b.schema.field(0).type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()], strict=True)))
            names = b.column(0).to_pylist()
            for i, ids in words.documents(*buffers(b.column(1))):
                ids = np.concatenate((ids.astype("<u4"), tail))
                packer.add(names[i], 0, ids, len(ids))
                if len(packer.rows) > 50_000:
                    yield _batch(packer.rows, schema)
                    packer.rows = []
        if schema is not None:
            packer.finish()
            # What is left keeps its ids; sequence_id then names the task.
            rest = [(doc, start, len(ids), 0, n, task, 0, 0, 0, ids.tobytes()) for doc, start, ids, n in packer.left()]
            yield _batch(packer.rows + rest, schema)

    done = materialize(source.mapInArrow(tidy(run, True), kinds), "packed")
    # Sequence ids of gathered rests lie in a range of their own, beyond any task's.
    second = 1 << 62

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(second + (int(key[0]) << 32), tiers)
        for r in pdf.sort_values(["sequence_id", "_doc", "start", "_ids"]).itertuples(index=False):
            packer.add(None if pd.isna(r[0]) else r[0], int(r.start), np.frombuffer(r[9], "<u4"), int(r.doc_tokens))
        packer.finish()
        packer.finish_at_powers()
        out = pd.DataFrame(packer.rows, columns=_FIELDS).drop(columns="_ids")
        return out

    kept = [c for c in done.columns if c != "_ids"]
    rests = done.filter("_ids IS NOT NULL").withColumn("_gather", F.expr(f"sequence_id DIV {GATHER}")).groupBy("_gather").applyInPandas(gather, kinds.rpartition(",")[0])
    return done.filter("_ids IS NULL").select(*kept).unionByName(rests).withColumnRenamed("_doc", id_col)
