"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Every text gets a class key (128 bits of its word sequence) and band hashes
   of its MinHash signature. Bands and rows come from the target recall.
2. Texts of equal word sequences form a class, joined once, whatever its size.
   From here on classes are named by their keys; ids are labels at the end.
3. Band hashes are shuffled. Classes that share one are candidates: a pair links
   if it shares a band and its full n-gram sets reach the threshold.
4. Candidates that hang together through few classes (COMPONENT_CHUNKS chunks)
   are verified together. Where band hashes chain more than that together, each
   band's group is verified by itself, and a pair counts in the first band that
   it shares. Both ways give the same links; no class meets more others than
   its bands, or that many chunks, hold.
5. Groups are dealt into chunks of bounded size by hash, and every pair of
   chunks is a block, so a group of any size is spread over many tasks. Texts
   travel as compressed bundles per chunk; small groups share blocks.
6. A block counts the common n-grams of all its pairs: frequent n-grams by matrix
   product, rare ones by their short posting lists. Only counts per class and
   links to the smallest partner leave it, never pairs.

A word is a run of letters and digits, in lower case: every other ASCII character
parts words, every other character is part of one. N-grams are five words,
hashed to 64 bits and compared as sets.

Defined results: a null text or one without words links with nothing, and is a
class of its own; a text with fewer words than an n-gram has one n-gram, all
its words; long texts are worked on in whole; rows that repeat an id are rows of
their own, each with the links of its text; of rows with equal id in one
component `drop_near_duplicates` keeps one; rows without id link with nothing
and stay; an empty table gives no row; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import ascii_words, bounded_batches, buffers, mix, row_blocks, span_hashes, text_blocks, tidy
from quillveil.llm.components import connected_components
from quillveil.session import materialize, partitions_for, small_side

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
MOST_HASHES = 128
CHUNK_DOCS = 1024
CHUNK_NGRAMS = 500_000
COMPONENT_CHUNKS = 8
SHARED_DOCS = 96
_FREQUENT = 24
_BUNDLE_BYTES = 8 << 20
_BREAKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SEED = 0x1B873593CC9E2D51


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, enough for the recall at the threshold, need no more hashes than `most`."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED) + np.uint64(salt))


def ngrams(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts and the first of each text (with one past the end); word hashes and the first of each text."""
    s, e, first = ascii_words(data, off, _BREAKS)
    h = span_hashes(data, s, e)
    n = len(h)
    count = np.diff(first)
    grams = np.zeros(n, np.uint64)
    for j in range(min(words, n)):
        grams[: n - j] += h[j:] * np.uint64(pow(_SEED | 1, j + 1, 1 << 64))
    whole = np.maximum(count - words + 1, np.minimum(count, 1))
    starts = np.cumsum(whole) - whole
    row = np.repeat(np.arange(len(count)), whole)
    at = first[:-1][row] + np.arange(len(row)) - starts[row]
    out = grams[at]
    for i in np.flatnonzero((count > 0) & (count < words)).tolist():
        own = h[first[i] : first[i + 1]]
        out[starts[i]] = np.bitwise_xor.reduce(mix(own * np.uint64(_SEED | 1) + np.arange(len(own), dtype=np.uint64) + np.uint64(len(own) << 32)))
    return mix(out), np.append(starts, len(out)), h, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[first[1:]] - sums[first[:-1]]


def _signatures(id_type: str, bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _seeds(bands * rows, 1) | np.uint64(1)
        for b in batches:
            data, off = buffers(b.column(1))
            keys, sizes, sigs = [], [], []
            for lo, hi in row_blocks(off):
                grams, first, h, at = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
                one, two = (_sums(mix(h ^ mix(place + np.uint64(salt))), at) for salt in (11, 13))
                keys.append(np.stack([one, two], axis=1))
                size = np.diff(first)
                sizes.append(size)
                sig = np.zeros((hi - lo, bands), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    for j in range(bands):
                        for k in range(rows):
                            low = np.minimum.reduceat(grams * mult[j * rows + k], first[:-1][full])
                            sig[full, j] = mix(sig[full, j] * np.uint64(3) + low + np.uint64(j))
                sigs.append(sig)
            key, size, sig = np.concatenate(keys), np.concatenate(sizes), np.concatenate(sigs)
            ids = b.column(0)
            use = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            raw = key.astype("<u8").tobytes()
            names = pa.array([raw[16 * i : 16 * i + 16] if u else None for i, u in enumerate(use.tolist())], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(sig.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([ids, b.column(2), names, pa.array(size.astype(np.int64)), lists], names=["doc", "t", "class", "n", "bands"])

    return run, f"doc {id_type}, t bigint, class binary, n bigint, bands array<bigint>"


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed bundles of texts, one for each chunk in a batch, sent to every block of the chunk."""
    for b in text_blocks(batches, "text", _BUNDLE_BYTES):
        copies, band, group, chunk, chunks = (b.column(i).to_numpy() for i in range(2, 7))
        names, bands = b.column(0).to_pylist(), b.column(1)
        sigs = bands.values.to_numpy()[bands.offsets[0].as_py() :].reshape(len(names), -1) if len(names) else np.zeros((0, 0), np.int64)
        data, off = buffers(b.column(7))
        keys: list[tuple] = []
        order = np.lexsort((chunk, group, band))
        cuts = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(group[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
        for at in np.split(order, cuts) if len(order) else []:
            texts = [data[off[i] : off[i + 1]] for i in at.tolist()]
            head = np.array([len(at), sigs.shape[1], *copies[at], *map(len, texts), *sigs[at].ravel()], "<i8").tobytes()
            value = zstandard.ZstdCompressor(level=1).compress(head + b"".join(names[i] for i in at.tolist()) + b"".join(x.tobytes() for x in texts))
            i, c = at[0], int(chunk[at[0]])
            keys += [(int(band[i]), int(group[i]), min(c, j), max(c, j), int(c > j), value) for j in range(int(chunks[i]))]
        columns = list(zip(*keys, strict=True)) if keys else [[]] * 6
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["band", "group", "a", "b", "side", "data"])


def _sets(values: list[bytes], words: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class keys, copies, band hashes, set sizes of the texts in some bundles, and (row, n-gram) pairs, each once."""
    names, copies, sigs, rows, grams, base = [], [], [], [], [], 0
    for v in values:
        raw = zstandard.ZstdDecompressor().decompress(v)
        n, width = np.frombuffer(raw, "<i8", 2).tolist()
        head = np.frombuffer(raw, "<i8", (2 + width) * n, 16)
        at = 16 + 8 * (2 + width) * n
        data, off = np.frombuffer(raw, np.uint8, -1, at + 16 * n), np.concatenate(([0], np.cumsum(head[n : 2 * n])))
        names += [raw[at + 16 * i : at + 16 * i + 16] for i in range(n)]
        copies.append(head[:n])
        sigs.append(head[2 * n :].reshape(n, width))
        for lo, hi in row_blocks(off):
            g, first, _, _ = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            row = np.repeat(np.arange(lo, hi), np.diff(first))
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            new = np.concatenate(([True], (np.diff(row) != 0) | (g[1:] != g[:-1])))[: len(g)]
            rows.append(row[new] + base)
            grams.append(g[new])
        base += n
    row, gram = np.concatenate(rows), np.concatenate(grams)
    return names, np.concatenate(copies), np.concatenate(sigs), np.bincount(row, minlength=base), row, gram


def _first_shared(sigs: np.ndarray) -> np.ndarray:
    """Matrix of the first band that two rows share, -1 where they share none."""
    out = np.full((len(sigs), len(sigs)), -1, np.int16)
    for j in range(sigs.shape[1] - 1, -1, -1):
        out[sigs[:, j, None] == sigs[None, :, j]] = j
    return out


def common_counts(n: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of common n-grams of all pairs of n sets, given as (row, n-gram) pairs."""
    order = np.lexsort((row, gram))
    row, gram = row[order], gram[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))[: len(gram)])
    size = np.diff(np.append(first, len(gram)))
    counts = np.zeros((n, n), np.float32)
    often = np.flatnonzero(size > _FREQUENT)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        m = np.zeros((n, len(part)), np.float32)
        shift = first[part] - (np.cumsum(size[part]) - size[part])
        at = np.repeat(shift, size[part]) + np.arange(int(size[part].sum()))
        m[row[at], np.repeat(np.arange(len(part)), size[part])] = 1
        counts += m @ m.T
    flat = counts.reshape(-1)
    for d in range(2, _FREQUENT + 1):
        these = first[size == d]
        for lo in range(0, len(these), max(1, 1_000_000 // (d * d))):
            p = row[these[lo : lo + max(1, 1_000_000 // (d * d)), None] + np.arange(d)]
            cell, add = np.unique((p[:, :, None] * n + p[:, None, :]).ravel(), return_counts=True)
            flat[cell] += add
    return counts


def _verify(threshold: Fraction, words: int):
    """All candidate pairs of each block, from a partition sorted by block."""
    schema = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def block(band: int, sides: dict[int, list[bytes]], same: bool) -> list[tuple]:
        names, copies, sigs, size, row, gram = _sets(sides.get(0, []) + sides.get(1, []), words)
        left = sum(int(np.frombuffer(zstandard.ZstdDecompressor().decompress(v), "<i8", 1)[0]) for v in sides.get(0, []))
        # Classes in the order of their keys; one whose text came from several equal rows counts once.
        place: dict[bytes, int] = {}
        for i, x in enumerate(names):
            place.setdefault(x, i)
        names = sorted(place)
        pick = np.array([place[x] for x in names], np.int64)
        at = np.full(len(size), -1, np.int64)
        at[pick] = np.arange(len(pick))
        row, use = at[row], at[row] >= 0
        row, gram = row[use], gram[use]
        n, size, copies, sigs, part = len(pick), size[pick], copies[pick], sigs[pick], pick < left
        common = common_counts(n, row, gram).astype(np.int64)
        p, q = threshold.numerator, threshold.denominator
        links = common * (p + q) >= p * (size[:, None] + size[None, :])
        links &= common > 0
        np.fill_diagonal(links, False)
        if not same:
            links &= part[:, None] != part[None, :]
        if links.any():
            shared = _first_shared(sigs)
            links &= shared >= 0 if band < 0 else shared == band
        count = links @ copies
        root = np.arange(n)
        while True:
            low = np.minimum(root, np.where(links, root[None, :], n).min(axis=1, initial=n))
            if np.array_equal(low, root):
                break
            root = low
        return [(names[i], int(count[i]), names[root[i]]) for i in np.flatnonzero(count).tolist()]

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, done = None, {}, []
        for b in batches:
            for band, g, x, y, side, value in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if (band, g, x, y) != now:
                    if now:
                        done += block(now[0], sides, now[2] == now[3])
                    now, sides = (band, g, x, y), {}
                sides.setdefault(side, []).append(value)
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now:
            done += block(now[0], sides, now[2] == now[3])
        if done:
            yield out(done)

    return run


def _chunks(docs: str = "docs", grams: str = "grams"):
    """Chunks that a group of so many classes and n-grams is dealt into."""
    return F.greatest(F.ceil(F.col(docs) / CHUNK_DOCS), F.ceil(F.col(grams) / CHUNK_NGRAMS)).cast("long")


def _placed(classes: DataFrame) -> DataFrame:
    """(class, band, group, chunk, chunks): where each class that shares a band is verified; band is -1 where whole components are."""
    banded = classes.select("cid", F.posexplode("bands").alias("band", "h")).select("cid", "band", F.xxhash64("band", "h").alias("h"))
    shared = materialize(banded.groupBy("h").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).filter("first < last").select("h", "first"), "jaccard-bands")
    stars = banded.join(shared, "h").filter("cid > first").select("cid", "first")
    groups = connected_components(stars, "cid", "first").select(F.col("node").alias("cid"), F.col("component").alias("group"))
    sized = materialize(groups.join(classes.select("cid", "class", "n"), "cid"), "jaccard-sized")
    totals = sized.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    chunks = materialize(totals.select("group", _chunks().alias("chunks")), "jaccard-chunks")
    n_shared = max(1, sized.count() // SHARED_DOCS)
    dealt = sized.join(chunks, "group")
    whole = dealt.filter(F.col("chunks") <= COMPONENT_CHUNKS).select(
        "class",
        F.lit(-1).alias("band"),
        # Groups of one chunk share blocks, numbered below all others.
        F.when(F.col("chunks") > 1, F.col("group")).otherwise(F.lit(-(1 << 62)) + F.pmod(F.xxhash64("group"), F.lit(n_shared))).alias("group"),
        F.pmod(F.xxhash64("class"), "chunks").alias("chunk"),
        "chunks",
    )
    if chunks.filter(F.col("chunks") > COMPONENT_CHUNKS).isEmpty():
        return whole
    chained = dealt.filter(F.col("chunks") > COMPONENT_CHUNKS).select("cid", "class", "n")
    members = materialize(banded.join(shared.select("h"), "h").join(chained, "cid").select("class", "n", "band", "h"), "jaccard-members")
    sizes = materialize(members.groupBy("h").agg(F.count("*").alias("docs"), F.sum("n").alias("grams")).select("h", _chunks().alias("chunks")), "jaccard-band-chunks")
    parts = members.join(sizes, "h").select("class", "band", F.col("h").alias("group"), F.pmod(F.xxhash64("class"), "chunks").alias("chunk"), "chunks")
    return whole.unionByName(parts)


def _linked(docs: DataFrame, threshold: Fraction, recall: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc, t (hash of its text in lower case), root (a class of its component), class_id, n_links, component_id."""
    bounded_batches(docs.sparkSession)
    bands, rows = choose_bands(float(threshold), recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).withColumn("t", F.xxhash64("text"))
    sign, schema = _signatures("bigint", bands, rows, words)
    signed = materialize(source.select("doc", "text", "t").mapInArrow(tidy(sign), schema), "jaccard-signed")
    # All texts of a class have the same n-grams, so any of them stands for it.
    grouped = signed.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc", "t")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Candidates go by a hash of the class; classes that share it only become candidates.
    classes = materialize(grouped.select("class", F.xxhash64("class").alias("cid"), "rep.doc", "rep.t", "copies", "n", "bands"), "jaccard-classes")

    # Written, so that its size is known: texts do not move where it is small enough to be broadcast.
    known = materialize(_placed(classes).join(classes.select("class", "doc", "t", "copies", "bands"), "class"), "jaccard-placed")
    texts = small_side(known).join(source, ["doc", "t"]).select("class", "bands", "copies", "band", "group", "chunk", "chunks", "text")
    keys = ("band", "group", "a", "b")
    bundles = texts.mapInArrow(tidy(_bundle), "band int, group bigint, a int, b int, side int, data binary").repartition(partitions_for(docs), *keys).sortWithinPartitions(*keys)
    found = materialize(bundles.mapInArrow(tidy(_verify(threshold, words)), "class binary, links bigint, root binary"), "jaccard-links")

    components = connected_components(found, "class", "root").select(F.col("node").alias("class"), F.col("component").alias("root"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    linked = materialize(counts.join(components, "class").join(classes.select("class", F.col("doc").alias("rep")), "class"), "jaccard-linked")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("_component"))
    linked = linked.join(smallest, "root").select("class", "links", "root", "_component")
    verdict = classes.select("class", F.col("doc").alias("rep"), "copies").join(linked, "class", "left")
    verdict = materialize(verdict.select("class", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("root", "class").alias("root"), F.coalesce("_component", "rep").alias("_component")), "jaccard-verdict")
    out = signed.select("doc", "t", "class").join(verdict, "class", "left")
    return out.select("doc", "t", "root", F.coalesce("rep", "doc").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "doc").alias("component_id"))


_STAYS = "coalesce(doc = component_id, true)"


def link_documents(docs: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links (documents linked directly), component_id, kept (smallest id of its component)."""
    out = _linked(docs, threshold, recall, words, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), "class_id", "n_links", "component_id", F.expr(_STAYS).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component (that of the smallest id), with all their columns."""
    verdict = materialize(_linked(docs, threshold, recall, words, id_col, text_col).withColumn("stays", F.expr(_STAYS)), "jaccard-kept")
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.col(f"c{names.index(id_col)}").cast("long")
    text = F.xxhash64(F.lower(F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))))
    gone = verdict.filter("NOT stays").select(F.col("doc").alias("_doc"), F.col("t").alias("_t"))
    repeats = verdict.filter("stays AND doc IS NOT NULL").groupBy("doc", "root").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    if repeats.filter("n > 1").isEmpty():
        return safe.join(small_side(materialize(gone.distinct(), "jaccard-gone")), (key == F.col("_doc")) & (text == F.col("_t")), "left_anti").toDF(*names)
    # Rows that repeat an id: of those in one component one text stays, once.
    first = materialize(repeats.select(F.col("doc").alias("_doc"), F.col("t").alias("_t")).distinct(), "jaccard-first")
    named = safe.filter(key.isNotNull()).join(small_side(first), (key == F.col("_doc")) & (text == F.col("_t")), "left_semi")
    named = named.withColumn("_t", text).dropDuplicates([f"c{names.index(id_col)}", "_t"]).drop("_t")
    return named.unionByName(safe.filter(key.isNull())).toDF(*names)


#: DuckDB SQL for `link_documents` of a documents table of distinct ids, by comparison of all pairs with a common n-gram.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc, b AS root FROM e UNION SELECT e.a, r.root FROM e JOIN r ON e.b = r.doc),
k AS (SELECT doc, least(min(root), doc) AS component FROM r GROUP BY doc),
q AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM t LEFT JOIN q ON q.a = doc_id LEFT JOIN k ON k.doc = doc_id"""
