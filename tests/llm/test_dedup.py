"""Repeated strings, n-gram joins, vectors and archives against brute force."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillveil.llm.ngram_join as N
import quillveil.llm.suffix_dedup as S
from quillveil.llm import warc
from quillveil.llm.components import connected_components
from quillveil.llm.embedding_dedup import link_vectors
from quillveil.llm.warc import ORACLE_SQL, parse_archive, read_archives, restore_payloads, warc_round_trip, write_archives
from tests.llm import reference as R


def spans_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_spans(df).collect()}


def test_suffixes(docs, rows, odd, none):
    assert spans_of(docs) == R.suffixes(rows)
    assert spans_of(odd) == R.suffixes([(r.doc_id, r.text) for r in odd.collect()])
    assert S.repeated_spans(none).count() == 0


def test_suffixes_of_edited_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 25)):
            w[rng.randrange(len(w))] = word()
        a = rng.randint(0, 200)
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 9))] + w[a : a + rng.randint(15, 200)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = R.suffixes(rows)
    assert spans_of(df) == want


@pytest.mark.parametrize("hot", [0, 3])
def test_suffixes_of_hot_anchors(spark, monkeypatch, hot):
    """With a low bound the suffixes of hot anchors go one by one; the result is the same."""
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + passage[: rng.randint(90, 260)] + "".join(rng.choice("xyz") for _ in range(9))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert spans_of(df) == R.suffixes(rows)


def test_sorted_parts_share_rows(monkeypatch):
    """Whatever the number of parts that a bucket is sorted in, spans leave it as one row for each document group."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 120, dtype=np.uint8) for _ in range(20)]
    docs = S.Docs(np.arange(8), np.arange(8) * 7, np.arange(8) % 2)
    doc, at = np.repeat(np.arange(8), 20), np.tile(np.arange(20), 8)
    one = np.ones(len(doc), np.int64)
    values = [S._with_bytes(head, np.concatenate([texts[k] for k in at[i]])) for _, i, head in S._packs(doc % 3, docs, doc, (at * 200).astype("<u4"), (21 * one).astype("u1"), (0 * one).astype("u1"), at.astype("<u8"))]
    rows = {}
    for part in (1 << 19, 300):
        monkeypatch.setattr(S, "_CHUNK", part)
        found = S._sort_bucket(values)
        assert sorted(r[0] for r in found) == [0, 1]
        rows[part] = []
        for *_, data in found:
            d, who, (start, size) = S._unpack([data])
            rows[part] += zip(d.k[who].tolist(), d.t[who].tolist(), start.tolist(), size.tolist(), strict=True)
    # All but the first document's.
    assert sorted(rows[300]) == sorted(rows[1 << 19]) == [(k, 7 * k, 200 * i, 120) for k in range(1, 8) for i in range(20)]


def test_sort_sees_what_may_repeat(monkeypatch):
    """Of segments with one anchor only suffixes that may have an equal one are sorted; ranks by packed keys are those of the keys."""
    rng = np.random.default_rng(5)
    seen, sort = [], S._sort_segments
    monkeypatch.setattr(S, "_sort_segments", lambda *a: seen.append(a[3].tolist()) or sort(*a))

    def spans(texts):
        n = len(texts)
        docs = S.Docs(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
        full = lambda v, t: np.full(n, v, t)
        rows = list(S._packs(full(0, np.int64), docs, np.arange(n), full(3, "<u4"), full(40, "u1"), full(50, "u1"), full(7, np.uint64)))
        out = S._sort_bucket([S._with_bytes(head, np.concatenate(texts)) for _, _, head in rows])
        if not out:
            return []
        docs, doc, (start, size) = S._unpack([x[3] for x in out])
        return sorted(zip(docs.k[doc].tolist(), start.tolist(), size.tolist(), strict=True))

    a, b, c = (rng.integers(0, 256, 139).astype(np.uint8) for _ in range(3))
    assert spans([a, b, c]) == [] and seen == []
    b[20:130] = a[20:130]
    assert spans([a, b, c]) == [(1, 23, 110)] and seen == [[11, 11]]
    keys = (rng.integers(-1, 3, 900), rng.integers(0, 1 << 63, 40).astype(np.uint64)[rng.integers(0, 40, 900)] * np.uint64(2), rng.integers(0, 1 << 50, 3)[rng.integers(0, 3, 900)], rng.integers(0, 900, 900) % 7)
    for some in (keys, keys[:1], keys[1:3], keys[::-1]):
        rows = list(zip(*[k.tolist() for k in some], strict=True))
        number = {r: i for i, r in enumerate(sorted(set(rows)))}
        assert S._rank(*some).tolist() == [number[r] for r in rows]


def test_settle_compares_bytes():
    """Segments whose hashes agree are told apart by their bytes."""
    texts = [b"a" * 120, b"a" * 120, b"b" * 120]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.arange(4) * 120
    docs = S.Docs(np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64))
    same = np.full(3, 7, np.uint64)
    stay, _, later = S._settle(docs, np.arange(3), np.zeros(3, np.int64), data, off[:3], np.full(3, 120), same, same)
    assert sorted(stay.tolist()) == [0, 2] and later.tolist() == [1]


def test_suffixes_many_in_one_bucket(spark, monkeypatch):
    """A bucket of many segments, none of them in a large part of one block, is split as well."""
    rng = random.Random(14)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(80))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + passage + "".join(rng.choice("xyz") for _ in range(30))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows[:9]]
    monkeypatch.setattr(S, "MANY", 5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert spans_of(df) == R.suffixes(rows)


def test_suffixes_long_and_repetitive(spark):
    rows = [(1, "ab" * 900_000), (2, "z" * 250), (3, "Z" * 99), (4, "ab" * 60), (5, ("0123456789" * 30))]
    got = spans_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got[1][1] == 1_800_000 - 2 and got[1][2] == 1
    assert got[2] == R.suffixes(rows[1:])[2] and got[3][1] == 0 and got[4][1] == 120
    assert got[5] == R.suffixes(rows[4:])[5]


def test_suffixes_odd_ids(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=150))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (7, text + "!")], "doc_id bigint, text string")
    got = sorted((r.doc_id is not None, r.n_bytes, r.n_removed) for r in S.repeated_spans(df).collect())
    assert got == [(False, 150, 0), (True, 150, 150), (True, 150, 150), (True, 151, 150)]


def test_remove_repeats_keeps_columns(spark):
    text = "".join(random.Random(6).choices("abcdéfgh", k=150))
    df = spark.createDataFrame([(1, text, "a", 5), (2, "x" + text + "y", "b", 6), (3, None, "c", None)], "doc_id bigint, text string, group string, _sd_k int")
    got = {r.doc_id: tuple(r) for r in S.remove_repeats(df).collect()}
    assert got == {1: (1, text, "a", 5), 2: (2, "xy", "b", 6), 3: (3, None, "c", None)}
    assert S.remove_repeats(df).schema == df.schema


def test_difference_cover():
    for v in (4, 7, 16, 32):
        c = set(S.difference_cover(v))
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_cover_ranks():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    r = S.CoverRanks(text)
    at = np.flatnonzero(r.number[:400] >= 0)
    key = [text[i : i + r.reach].tobytes() for i in at]
    rank = [int(r.rank[r.number[i]]) for i in at]
    order = sorted(range(len(at)), key=lambda k: key[k])
    assert all((rank[a] < rank[b]) == (key[a] < key[b]) for a, b in zip(order[:-1], order[1:]))


def links_of(df):
    return {r.doc_id: (r.n_links, r.component_id, r.kept) for r in N.link_documents(df).collect()}


def test_jaccard(docs, rows, odd, none):
    assert links_of(docs) == R.jaccard(rows)
    assert links_of(odd) == R.jaccard([(r.doc_id, r.text) for r in odd.collect()])
    assert N.link_documents(none).count() == 0


@pytest.mark.parametrize("chunk", [1024, 8])
def test_jaccard_of_a_large_group(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK_DOCS", chunk)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice((0, 0, 1, 2, 3, 8))):
            w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    assert links_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == R.jaccard(rows)


def test_jaccard_of_repeated_ids(spark):
    """Two texts under one id keep their own links; near copies of either go."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " end"), (3, a + " end")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in N.link_documents(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in N.drop_near_duplicates(df).collect()) == [(1, a), (1, b)]
    df = spark.createDataFrame([(0, a), (1, a + " end"), (1, b), (2, b + " end")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in N.drop_near_duplicates(df).collect()) == [(0, a), (1, b)]


def test_jaccard_of_chains(spark, monkeypatch):
    """A long chain of near copies is one component; verified by bands, its links are those of brute force and its work grows with its length."""
    for name, value in (("COMPONENT_CHUNKS", 1), ("CHUNK_DOCS", 16)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(21)
    words, rows = [f"w{rng.randrange(9000)}" for _ in range(80)], []
    for i in range(400):
        words = words[2:] + [f"v{rng.randrange(9000)}", f"u{i}"]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert links_of(df) == R.jaccard(rows)
    signed = df.selectExpr("doc_id doc", "text", "xxhash64(text) t")
    sign, schema = N._signatures("bigint", *N.choose_bands(0.8, N.RECALL), N.WORDS)
    classes = signed.mapInArrow(sign, schema).selectExpr("class", "xxhash64(class) cid", "n", "bands")
    placed = N._placed(classes)
    members = [r["count"] for r in placed.groupBy("band", "group").count().collect()]
    # All pairs of the chain are 79800; those of its bands stay near its length times the width of a band's group.
    assert placed.filter("band < 0").count() == 0 and max(members) < 40 and sum(n * (n - 1) // 2 for n in members) < 79800 // 2


def test_jaccard_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " x"), (3, "short")]
    got = links_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


def test_jaccard_at_the_threshold(spark):
    """Nine and eight of ten n-grams: 9 common of 9 + 9 - ... is decided in whole numbers."""
    a = [f"a{i}" for i in range(13)]  # 9 n-grams
    b = a[:12] + ["x"]  # 8 of 9 in common: 8 / 10 = 0.8
    c = a[:11] + ["y", "z"]  # 7 of 9: 7 / 11
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = links_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[3][0] == 0


def test_drop_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long + " end", "b"), (9, "other words here", "c"), (9, "other words here", "c"), (None, long, "d"), (8, None, "e"), (4, "", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    got = sorted(((r.doc_id, r["class"]) for r in N.drop_near_duplicates(df).collect()), key=str)
    assert got == [(3, "b"), (4, "f"), (8, "e"), (9, "c"), (None, "d")]


def test_bands():
    bands, rows = N.choose_bands(0.8, 0.9995)
    assert bands * rows <= N.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)]
    sets = R.Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: sets.find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()][:250]
    rng = random.Random(9)
    near = [(10_000 + i, [x + rng.gauss(0, s) for x in rows[i % 7][1]], rows[i % 7][2]) for i, s in enumerate([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08] * 9)]
    v = rows[0][1]
    odd = [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [None, *v[1:]], 1), (20_003, [float("nan"), *v[1:]], 1), (20_004, v, None), (20_005, v[:10], rows[0][2]), (20_006, v[:10], rows[0][2]), (20_007, [], 1), (20_008, [float("inf"), *v[1:]], 1)]
    every = rows + near + odd
    data = spark.createDataFrame([(i, e, l, 0, "k") for i, e, l in every], "vec_id bigint, embedding array<double>, label int, rep int, key string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(data, block_rows=20).collect()}
    assert got == R.vectors(every)
    assert sum(x[0] > 0 for x in got.values()) > 20
    assert link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_vectors_of_repeated_ids(spark):
    """Vectors under one id are vectors of their own."""
    u, v = [1.0] + [0.0] * 9, [0.0] * 9 + [1.0]
    near = lambda x: [y + 0.01 for y in x]
    df = spark.createDataFrame([(1, u, 1), (1, v, 1), (2, near(v), 1), (3, near(u), 1), (None, u, 1), (4, u, 2)], "vec_id bigint, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in link_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (None, 2, 1), (4, 0, 4)], key=str)


def test_block_pairs_grow_with_the_near_ones(spark):
    """Of blocks along a line only neighbours are paired, at every level."""
    from quillveil.llm.embedding_dedup import near_blocks

    rows = [((p << 32) + i, 1, 64, [float(p * 50 + i)] + [0.0] * 7, [p * 50 + i + 0.5] + [0.0] * 7) for p in range(20) for i in range(50)]
    df = spark.createDataFrame(rows + [(r[0], 2, *r[2:]) for r in rows[:3]], "block bigint, label int, dim int, lo array<double>, hi array<double>")
    pairs = {tuple(r) for r in near_blocks(df.filter("label = 1"), 0.6).collect()}
    names = [r[0] for r in rows]
    assert pairs == {(a, a) for a in names} | set(zip(names[:-1], names[1:]))


PAGES = [(1, "u", "<p>a</p>"), (2, "u\r\nX: y", "<p>a</p>"), (3, None, None), (4, "u", ""), (5, "u", "line\r\n\r\nWARC/1.1\r\n\r\nend\r\n\r\n"), (6, "u", "é😀"), (7, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "only"), (9, "u", "x" * 100_000), (7, "u", "<p>a</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "r") for p in PAGES], "page_id bigint, url string, html string, record_type string")


def test_warc(spark, pages):
    got = [tuple(r) for r in warc_round_trip(pages).collect()]
    want = R.warc([(p, h) for p, _, h in PAGES])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_come_back(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TIERS", (50, 1000, None))
    write_archives(pages, f"{tmp_path}/w", file_bytes=6000, date="2024-05-06T07:08:09Z")
    got = sorted(((r.page_id, bytes(r.payload).decode()) for r in restore_payloads(spark, f"{tmp_path}/w").collect()), key=str)
    assert got == sorted(((p, h or "") for p, _, h in PAGES), key=str)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 4 and all(f.name.endswith(".gz") for f in files)
    kinds = []
    for f in files:
        raw = gzip.decompress(f.read_bytes())
        assert len(raw) < 2 * 6000 or raw.count(b"WARC/1.1") == 1
        for headers, _ in parse_archive(raw):
            kinds.append(headers["WARC-Type"])
            assert headers["WARC-Record-ID"].startswith("<urn:uuid:") and headers["WARC-Date"] == "2024-05-06T07:08:09Z"
            for name in ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"):
                assert (name in headers) == (headers["WARC-Type"] == "revisit")
    assert kinds.count("warcinfo") == 1 and set(kinds) == {"warcinfo", "response", "revisit"}


def test_warc_is_read_in_pieces():
    rec = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 5000]
    raw = b"".join(map(rec, bodies))
    zipped = b"".join(gzip.compress(rec(b)) for b in bodies)
    for n in (1, 7, 4096):
        assert [b for _, b in parse_archive(raw[i : i + n] for i in range(0, len(raw), n))] == bodies
    assert [b for _, b in parse_archive(warc._unzipped(memoryview(zipped)))] == bodies
    with pytest.raises(ValueError, match="Content-Length"):
        list(parse_archive(raw[:-1]))


def test_warc_damage_is_found(spark, pages, tmp_path):
    write_archives(pages.filter("page_id = 6"), f"{tmp_path}/w")
    f = next(x for x in (tmp_path / "w").iterdir() if x.name.startswith("part-") and "é".encode() in gzip.decompress(x.read_bytes()))
    f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace("é".encode(), "è".encode())))
    (tmp_path / "w" / f".{f.name}.crc").unlink()
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, f"{tmp_path}/w").collect()


def test_warc_sql(spark, small):
    import duckdb

    got = sorted((tuple(r) for r in warc_round_trip(spark.read.parquet(f"{small}/pages.parquet")).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    assert sorted(con.execute(ORACLE_SQL).fetchall(), key=str) == got
