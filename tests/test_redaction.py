import pytest
from pyspark.sql import functions as F

from quillveil.functions.html import patterns, sanitized, visible_text
from quillveil.functions.text import cut_spans, merge_spans
from quillveil.operators.apply import redact_text
from quillveil.operators.matching import find_hits
from quillveil.plans.redaction import redact, run_request
from quillveil.plans.rules import RequestError, parse_request, preset_rules, regex_rules, search_rule
from quillveil.sources.readers import read_files
from quillveil.sources.sinks import report_rows, write_passed

SCHEMA = "doc_id bigint, page int, text string"


def test_overlapping_rules_leave_nothing(spark):
    pages = spark.createDataFrame([(1, 0, "Dupont, write dupont@mail.org now")], SCHEMA)
    out = redact(pages, [search_rule("Dupont"), *preset_rules(["email"])])
    assert out.redacted.first().text == ", write  now"
    assert out.verdict.first().status == "pass"


def test_part_of_a_word(spark):
    pages = spark.createDataFrame([(1, 0, "CAT CATCH")], SCHEMA)
    rules = regex_rules("CAT")
    assert redact_text(pages, find_hits(pages, rules)).first().text == " CH"


def test_removed_and_kept_make_the_original(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.lit(0).alias("page"), "text")
    hits = find_hits(docs, [search_rule("the", ignore_accents=False)])
    out = redact_text(docs, hits, "\u0001").join(docs.select("doc_id", F.col("text").alias("old")), "doc_id")
    found = {r.doc_id: sorted(r.m) for r in hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "match")).alias("m")).collect()}
    for r in out.collect():
        parts = r.text.split("\u0001")
        words = [m.match for m in found.get(r.doc_id, [])]
        assert "".join(p + w for p, w in zip(parts, [*words, ""], strict=True)) == r.old


def test_empty_matches_redact_nothing(spark):
    pages = spark.createDataFrame([(1, 0, "xaay")], SCHEMA)
    hits = find_hits(pages, regex_rules("a*"))
    assert hits.count() == 4
    assert redact_text(pages, hits).first().text == "xy"


def test_ban_fails_and_nothing_is_written(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "a@b.org secret"), (2, 0, "a@b.org")], SCHEMA)
    request = parse_request({"presets": {"keys": ["email"]}, "audit": {"patterns": ["secret"]}})
    out = run_request(pages, request)
    assert {r.doc_id: (r.status, r.total_matches, r.components_failed) for r in out.verdict.collect()} == {1: ("fail", 1, ["ban"]), 2: ("pass", 0, [])}
    write_passed(out.redacted, out.verdict, f"{tmp_path}/out")
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    assert not report_rows(out.verdict).filter("truncated").count()


def test_line_break_leak_is_seen_by_the_plain_reader(spark):
    pages = spark.createDataFrame([(1, 0, "Jean\nDupont")], SCHEMA)
    out = redact(pages, regex_rules("zzz"), regex_rules("Jean Dupont"))
    assert [(r.seen_by, r.match) for r in out.leaks.collect()] == [(["plain"], "Jean Dupont")]
    assert out.verdict.first().status == "fail"


def test_unread_parts_stop_it(spark):
    pages = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, "x")], SCHEMA)
    unread = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, n_unread long, n_left long")
    got = lambda mode: {r.doc_id: (r.status, r.coverage) for r in redact(pages, [search_rule("zz")], unread=unread, mode=mode).verdict.collect()}
    assert got("review") == {1: ("inconclusive", "acknowledged"), 2: ("pass", "acknowledged"), 3: ("pass", "complete")}
    assert got("block")[2][0] == "inconclusive"
    assert got("ignore") == {1: ("pass", "skipped"), 2: ("pass", "skipped"), 3: ("pass", "complete")}


def test_merge_and_cut(spark):
    spans = F.expr("array(named_struct('start', 4, 'end', 6), named_struct('start', 0, 'end', 2), named_struct('start', 2, 'end', 3), named_struct('start', 5, 'end', 9))")
    r = spark.range(1).select(merge_spans(spans).alias("m")).select("m", cut_spans(F.lit("0123456789"), F.col("m"), "_").alias("t")).first()
    assert [(s.start, s.end) for s in r.m] == [(0, 3), (4, 9)] and r.t == "_3_9"


def test_merge_and_cut_many(spark):
    """Against a plain loop, for many spans in any order and a long text."""
    import random

    rng = random.Random(3)
    for n, size in ((0, 10), (1, 10), (300, 20_000), (3000, 60_000)):
        text = "".join(rng.choice("abé😀") for _ in range(size))
        raw = [(a, min(size, a + rng.choice((0, 1, 5, 40)))) for a in (rng.randrange(size) for _ in range(n))]
        want = []
        for a, b in sorted(raw):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        df = spark.createDataFrame([(text, raw)], "t string, s array<struct<start:int,end:int>>")
        r = df.select(merge_spans(F.col("s")).alias("m"), "t").select("m", cut_spans(F.col("t"), F.col("m"), "_").alias("out")).first()
        assert [(x.start, x.end) for x in r.m] == [tuple(x) for x in want]
        parts, at = [], 0
        for a, b in want:
            parts.append(text[at:a])
            at = b
        assert r.out == "_".join([*parts, text[at:]])


def test_scope_beyond_the_last_page(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "a")], SCHEMA)
    request = lambda p: parse_request({"search": {"query": "a", "scope": {"pages": [p]}}})
    assert run_request(pages, request(1)).verdict.count() == 1
    with pytest.raises(RequestError, match="99999") as e:
        run_request(pages, request(99999))
    assert e.value.code == "invalid_scope"


def test_decomposed_name_cannot_pass(spark):
    pages = spark.createDataFrame([(1, 0, "Le\u0301o")], SCHEMA)
    out = redact(pages, [search_rule("Leo")])
    assert out.redacted.first().text == "" and out.verdict.first().status == "pass"
    left = redact(pages, [search_rule("zzz")], [search_rule("Leo")])
    assert left.verdict.first().status == "fail"


def test_html(spark):
    page = '<title>T</title><meta a><!-- c --><nav>n</nav><p onclick="x()" id=q>Text <a href="u">here</a></p><script>s</script><img alt="secret" src="data:image/png;base64,AAAA">'
    r = spark.createDataFrame([(page,)], "h string").select(sanitized(F.col("h")).alias("s"), visible_text(F.col("h")).alias("v")).first()
    for gone in ("T<", "meta", "c -", "nav", "onclick", "href", "secret", "base64", " s<"):
        assert gone not in r.s
    assert r.v == "Text here"
    assert len(patterns(frozenset({"remove_outline"}))) < len(patterns())
    with pytest.raises(ValueError, match="unknown switches"):
        patterns(frozenset({"x"}))


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 ... trailer << /Encrypt 5 0 R >>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.7 ...")
    got = {r.path.rsplit("/", 1)[1]: r.read_error for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "empty", "b.pdf": "not_a_pdf", "c.pdf": "encrypted", "d.pdf": None}


def test_very_many_matches(spark):
    text = "é the " * 3000
    pages = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, None)], SCHEMA)
    rule = search_rule("the", ignore_accents=False)
    got = sorted((r.start, r.end) for r in find_hits(pages, [rule]).collect())
    assert got == [(6 * i + 2, 6 * i + 5) for i in range(3000)]
    out = {r.doc_id: r.text for r in redact(pages, [rule]).redacted.collect()}
    assert out == {1: "é  " * 3000, 2: "", 3: None}


def test_requests_that_plain_text_cannot_honour(spark):
    pages = spark.createDataFrame([(1, 0, "a@b.org")], SCHEMA)
    rect = {"page": 0, "x0": 0, "y0": 0, "x1": 9, "y1": 9}
    for part in ({"rects": [rect]}, {"acknowledged_regions": [{"page": 0, "bbox": [0, 0, 9, 9]}]}, {"acknowledged_font_pages": [0]}, {"options": {"ocr_proposals": True}}, {"options": {"image_mode": "none"}}):
        with pytest.raises(RequestError, match=next(iter(part["options"] if "options" in part else part))) as e:
            run_request(pages, parse_request(part | {"presets": {"keys": ["email"]}}))
        assert e.value.code == "needs_layout"
    assert run_request(pages, parse_request({"full_page_rects": [rect], "options": {"image_regions": "block"}})).redacted.first().text == ""
