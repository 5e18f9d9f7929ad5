"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine of at least c are within eps = sqrt(2 - 2c) of each
other, and so are their projections on any orthonormal directions. Vectors are
projected on leading principal directions, given grid cells of side eps, and
sorted by cells in lexicographic order (the epsilon grid order). The sorted
sequence is cut into blocks of bounded size, whatever a label's share, and
neighbouring blocks into intervals, FAN at a time, up to one interval per label.
Pairs of intervals are joined recursively from the top: a pair whose bounding
boxes are farther apart than eps is skipped with all that it holds, any other is
replaced by the pairs of its parts, level by level, down to blocks. No key
gathers the blocks of a label; the work is that of the pairs that are near.
Inside a pair of blocks the same recursion halves intervals down to leaves, which
are compared in double precision.

The directions are fitted on a bounded sample (`FIT_ROWS` vectors); they
decide what can be skipped, never what is linked. Equal vectors of one
label are one class, known by a 128-bit key, compared once and counted with
their number.

Defined results: vectors that are null, empty, zero, or hold a null or a
non-finite component, and vectors without label, link with nothing; vectors of
different length never link; rows that repeat an id are vectors of their own
with that id; vectors at the threshold within rounding are decided by their raw
components; equal vectors share component and links; an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches
from quillveil.llm.components import connected_components
from quillveil.session import materialize, partitions_for

THRESHOLD = 0.98
FIT_ROWS = 2000
DIRECTIONS = 8
BLOCK_ROWS = 512
FAN = 16
_LEAF = 64
_SLACK = 1e-9


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, key, vec): key (of label and vector) and raw doubles are null where a vector cannot link."""
    for b in batches:
        keys, raws = [], []
        for value, label in zip(b.column(1), b.column(2), strict=True):
            v = None
            if value.is_valid and label.is_valid and len(value) and value.values.null_count == 0:
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                v = v if np.isfinite(v).all() and v.any() else None
            raw = None if v is None else v.astype("<f8").tobytes()
            keys.append(raw and hashlib.blake2b(raw, digest_size=16, person=hashlib.blake2b(repr(label.as_py()).encode(), digest_size=16).digest()).digest())
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "key", "vec"])


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_directions(classes: DataFrame, rows: int = FIT_ROWS, directions: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length, from a bounded sample by hash order."""
    sample = classes.select("vec").orderBy(F.xxhash64("key"), "key").limit(rows).collect()
    out: dict[int, np.ndarray] = {}
    for dim in {len(r.vec) // 8 for r in sample}:
        x = _unit(np.stack([np.frombuffer(r.vec, "<f8") for r in sample if len(r.vec) == 8 * dim]))
        _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[dim] = vt[:directions].T.copy()
    return out


def _project(unit: np.ndarray, bases: dict[int, np.ndarray], directions: int) -> np.ndarray:
    """Coordinates on the fitted directions, or on the first axes for a length outside the sample; padded with zeros."""
    dim = unit.shape[1]
    basis = bases.get(dim)
    got = unit[:, :directions] if basis is None else unit @ basis
    return np.pad(got, ((0, 0), (0, directions - got.shape[1])))


def _boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p.min(axis=0), p.max(axis=0)


def _apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether two sets of projected points are provably farther apart than eps."""
    (alo, ahi), (blo, bhi) = _boxes(a), _boxes(b)
    gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
    return float((gap * gap).sum()) > (eps + _SLACK) ** 2


def _ego_join(pa_: np.ndarray, pb: np.ndarray, ua: np.ndarray, ub: np.ndarray, ra: np.ndarray, rb: np.ndarray, c: float, eps: float, links: np.ndarray, x: int, y: int, same: bool) -> None:
    """Mark links of interval a (from x) with interval b (from y), halving both until leaves."""
    if not same and _apart(pa_, pb, eps):
        return
    n, m = len(pa_), len(pb)
    if max(n, m) <= _LEAF:
        cos = ua @ ub.T
        hit = cos >= c
        for i, j in zip(*np.nonzero(np.abs(cos - c) < 1e-12), strict=True):
            hit[i, j] = float(ra[i] @ rb[j]) / math.sqrt(float(ra[i] @ ra[i]) * float(rb[j] @ rb[j])) >= c
        links[x : x + n, y : y + m] = hit
        return
    h, k = (n + 1) // 2, (m + 1) // 2
    for a0, a1 in ((0, h), (h, n)):
        for b0, b1 in ((0, k), (k, m)):
            if a1 > a0 and b1 > b0:
                _ego_join(pa_[a0:a1], pb[b0:b1], ua[a0:a1], ub[b0:b1], ra[a0:a1], rb[b0:b1], c, eps, links, x + a0, y + b0, same and a0 == b0)


def _roots(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches inside this pair of blocks."""
    la, lb = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(links, lb[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(lb, np.where(links, na[:, None], top).min(axis=0, initial=top))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            return la, lb
        la, lb = na, nb


def near_blocks(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks of one label and length whose boxes come within reach.

    blocks: block (its task << 32, and its number there), label, dim, lo, hi
    """
    part, number = F.shiftright("block", 32), F.col("block").bitwiseAND((1 << 32) - 1)
    top = blocks.agg(F.max(part).alias("part"), F.max(number).alias("number")).first()
    if top.part is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    boxes = blocks.select("label", "dim", part.alias("part"), number.alias("number"), *[F.col(side)[j].alias(f"{side}{j}") for side in ("lo", "hi") for j in range(DIRECTIONS)])
    # Levels of intervals, blocks first: numbers shrink to one per task, then tasks to one.
    levels, part_now, number_now = [boxes], top.part, top.number
    bounds = [F.min(f"lo{j}").alias(f"lo{j}") for j in range(DIRECTIONS)] + [F.max(f"hi{j}").alias(f"hi{j}") for j in range(DIRECTIONS)]
    shrink = FAN.bit_length() - 1
    while part_now or number_now:
        below = levels[-1]
        up_part, up_number = (F.shiftright("part", shrink), F.col("number")) if not number_now else (F.col("part"), F.shiftright("number", shrink))
        part_now, number_now = (part_now >> shrink, number_now) if not number_now else (part_now, number_now >> shrink)
        levels[-1] = materialize(below.withColumns({"up_part": up_part, "up_number": up_number}), "ego-level")
        levels.append(levels[-1].groupBy("label", "dim", F.col("up_part").alias("part"), F.col("up_number").alias("number")).agg(*bounds))
    place = lambda p, n: F.shiftleft(F.col(p).cast("long"), 32).bitwiseOR(F.col(n).cast("long"))
    pairs = levels[-1].select("label", "dim", place("part", "number").alias("a"), place("part", "number").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda x: level.select("label", "dim", place("up_part", "up_number").alias(x), place("part", "number").alias(f"{x}_"), *[F.col(f"{e}{j}").alias(f"{x}_{e}{j}") for e in ("lo", "hi") for j in range(DIRECTIONS)])  # noqa: E731, B023
        gaps = [F.greatest(F.col(f"a_lo{j}") - F.col(f"b_hi{j}"), F.col(f"b_lo{j}") - F.col(f"a_hi{j}"), F.lit(0.0)) for j in range(DIRECTIONS)]
        near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= reach * reach
        both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        pairs = materialize(both.filter((F.col("a_") <= F.col("b_")) & near).select("label", "dim", F.col("a_").alias("a"), F.col("b_").alias("b")), "ego-pairs")
    return pairs.select("a", "b")


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    bounded_batches(vectors.sparkSession)
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    label_type = dict(vectors.dtypes)["label"]
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label").mapInArrow(_classes, f"vec_id bigint, label {label_type}, key binary, vec binary")
    rows = materialize(rows, "ego-rows")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = materialize(classes, "ego-classes")
    bases = fit_directions(classes)
    k = DIRECTIONS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x.as_buffer(), "<f8") for x in b.column(3)]
            cells = np.zeros((len(raw), k), np.int64)
            for dim in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == dim]
                cells[at] = np.floor(_project(_unit(np.stack([raw[i] for i in at])), bases, k) / eps) if eps else 0
            extra = [pa.array([len(v) for v in raw], pa.int32()), *[pa.array(cells[:, j]) for j in range(k)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=["label", "key", "copies", "vec", "dim", *[f"c{j}" for j in range(k)]])

    cells = [f"c{j}" for j in range(k)]
    placed = classes.select("label", "key", "copies", "vec").mapInArrow(place, f"label {label_type}, key binary, copies bigint, vec binary, dim int, " + ", ".join(f"{c} bigint" for c in cells))
    order = ("label", "dim", *cells, "key")
    parts = max(2, partitions_for(vectors))
    ordered = materialize(placed, "ego-placed").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal made
            raw = np.stack([np.frombuffer(h[2], "<f8") for h in held])
            lo, hi = _boxes(_project(_unit(raw), bases, k))
            values = [[base + made], [held[0][0]], [held[0][1]], [lo.tolist()], [hi.tolist()], [b"".join(h[3] for h in held)], [np.array([h[4] for h in held], "<i8").tobytes()], [raw.astype("<f8").tobytes()]]
            types = [pa.int64(), label_arrow, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["block", "label", "dim", "lo", "hi", "ids", "copies", "vecs"])

        for b in batches:
            label_arrow = b.schema.field("label").type
            for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if held and (row[:2] != held[0][:2] or len(held) >= block_rows):
                    yield block()
                held.append(row)
        if held:
            yield block()

    blocks = ordered.select("label", "dim", "vec", "key", "copies").mapInArrow(cut, f"block bigint, label {label_type}, dim int, lo array<double>, hi array<double>, ids binary, copies binary, vecs binary")
    blocks = materialize(blocks, "ego-blocks")

    pairs = near_blocks(blocks.select("block", "label", "dim", "lo", "hi"), eps + _SLACK)
    side = lambda name: blocks.select(F.col("block").alias(name), F.col("dim").alias(f"dim_{name}"), F.col("ids").alias(f"ids_{name}"), F.col("copies").alias(f"n_{name}"), F.col("vecs").alias(f"v_{name}"))
    work = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim_a", "ids_a", "n_a", "v_a", "ids_b", "n_b", "v_b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, dim, ids_a, n_a, v_a, ids_b, n_b, v_b = (batch.column(j)[i].as_py() for j in range(9))
                n_a, n_b = np.frombuffer(n_a, "<i8"), np.frombuffer(n_b, "<i8")
                ids_a, ids_b = ([x[16 * j : 16 * j + 16] for j in range(len(x) // 16)] for x in (ids_a, ids_b))
                names = sorted({*ids_a, *ids_b})
                number = {x: j for j, x in enumerate(names)}
                ra, rb = np.frombuffer(v_a, "<f8").reshape(-1, dim), np.frombuffer(v_b, "<f8").reshape(-1, dim)
                ua, ub = _unit(ra), _unit(rb)
                links = np.zeros((len(ra), len(rb)), bool)
                _ego_join(_project(ua, bases, k), _project(ub, bases, k), ua, ub, ra, rb, threshold, eps, links, 0, 0, a == b)
                if a == b:
                    np.fill_diagonal(links, False)
                la, lb = _roots(links, *[np.array([number[x] for x in ids], np.int64) for ids in (ids_a, ids_b)])
                out = [(ids_a, links @ n_a if a == b else links @ n_b, la)] + ([] if a == b else [(ids_b, links.T @ n_a, lb)])
                for ids, count, root in out:
                    at = np.flatnonzero(count)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in at], pa.binary()), pa.array(count[at].astype(np.int64)), pa.array([names[j] for j in root[at]], pa.binary())], names=["key", "links", "root"])

    found = materialize(work.mapInArrow(join, "key binary, links bigint, root binary"), "ego-links")
    parts_of = connected_components(found, "key", "root").select(F.col("node").alias("key"), F.col("component").alias("root"))
    counts = found.groupBy("key").agg(F.sum("links").alias("_links"))
    linked = materialize(counts.join(parts_of, "key").join(classes.select("key", "rep"), "key"), "ego-linked")
    linked = linked.join(linked.groupBy("root").agg(F.min("rep").alias("_component")), "root").select("key", "_links", "_component")
    verdict = classes.select("key", "rep", "copies").join(linked, "key", "left")
    verdict = materialize(verdict.select("key", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("_component", "rep").alias("_component")), "ego-verdict")
    component = F.coalesce("_component", "vec_id")
    return rows.select("vec_id", "key").join(verdict, "key", "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL for `link_vectors` of an embeddings table of distinct ids, by comparison of all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS vec, b AS root FROM e UNION SELECT e.a, r.root FROM e JOIN r ON e.b = r.vec),
k AS (SELECT vec, least(min(root), vec) AS component FROM r GROUP BY vec),
q AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN q ON q.a = vec_id LEFT JOIN k ON k.vec = vec_id"""
