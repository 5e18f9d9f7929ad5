"""Queries over layout: lines, runs, boxes, regions, fonts. Layout tables are made from the driver's tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.catalog.common import EMAIL_SQL, Entry, spans_sql, table, turns
from quillveil.functions.geometry import RECT, contains_rect, inverse_map, is_horizontal, mapped_rect, normalized, overlap_ratio, tightened
from quillveil.operators.apply import redact_glyphs, redact_images
from quillveil.operators.layout import document_lines, grid_glyphs, grid_words, letterspaced_runs, lines_of, match_boxes, nearest_next_lines, partial_word_boxes
from quillveil.operators.matching import find_hits
from quillveil.operators.plan import bucket_counts, dedupe, merge_ranges, over_cap
from quillveil.operators.proposals import propose
from quillveil.operators.unread import covered_parts, image_regions, review_groups, unacknowledged_fonts, unacknowledged_regions, uncovered_fonts, uncovered_regions, unreliable_fonts
from quillveil.plans.rules import preset_rules
from quillveil.session import materialize


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names, a word per character; every third name has uneven gaps."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split("c_name", "")).alias("i", "c")).filter("c <> ''")
    x = F.col("i") * 10.0 + F.when(F.col("c_custkey") % 3 == 0, F.col("i") * F.col("i")).otherwise(0)
    long = F.when((F.col("c_custkey") % 5 == 0) & (F.col("i") == 4), F.concat("c", "c")).otherwise(F.col("c"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), F.col("i").alias("word_no"), long.alias("text"), x.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (x + 6).cast("double").alias("x1"), F.lit(12.0).alias("y1"))


_LETTERS_SQL = """SELECT c_custkey AS doc_id, i, CASE WHEN c_custkey % 5 = 0 AND i = 4 THEN c || c ELSE c END AS text, x AS x0, x + 6 AS x1
 FROM (SELECT c_custkey, i - 1 AS i, substr(c_name, i, 1) AS c, (i - 1) * 10.0 + CASE WHEN c_custkey % 3 = 0 THEN (i - 1) * (i - 1) ELSE 0 END AS x
 FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS i FROM customer)) WHERE trim(c) <> ''"""
_RUNS_SQL = f"""
WITH w AS ({_LETTERS_SQL}), a AS (SELECT *, length(text) = 1 AS s, sum(CASE WHEN length(text) = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM w),
g AS (SELECT *, CASE WHEN s THEN x0 - lag(x1) OVER (PARTITION BY doc_id, island, s ORDER BY i) END AS gap FROM a),
r AS (SELECT *, count(*) OVER p AS n, min(CASE WHEN gap > 0 THEN gap END) OVER p AS lo, max(CASE WHEN gap > 0 THEN gap END) OVER p AS hi, row_number() OVER (PARTITION BY doc_id, island, s ORDER BY i) AS pos FROM g WINDOW p AS (PARTITION BY doc_id, island, s))
SELECT doc_id, i, text, s AND n >= 3 AND (lo IS NULL OR hi <= 2.0 * lo) AND pos > 1 AS glued FROM r"""


def letterspace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letterspaced_runs(_letters(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.when(F.col("glued"), 1)).alias("n_glued"), F.count("*").alias("n_words"))


def letterspaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(_letters(spark, sf_dir))
    return lines.select("doc_id", "text", "x0", "x1", F.size("spans").alias("n_spans"), F.element_at("spans", -1)["end"].alias("last_end"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' lines set in two columns."""
    lines = document_lines(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn")
    col, row = F.col("line_no") % 2, F.floor(F.col("line_no") / 2)
    x0, y0 = (col * 300).cast("double"), (row * 14 + col * 3).cast("double")
    return lines.select("doc_id", "page", F.lit(0).alias("block_no"), "line_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("text") * 6, F.lit(280))).cast("double").alias("x1"), (y0 + 12).alias("y1"))


def nearest_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_next_lines(_columns(spark, sf_dir)).select("doc_id", "page", F.col("a_line_no").alias("line_no"), F.col("b_line_no").alias("next_no"), "gap")


_TURN_LINES_SQL = r"""SELECT conv_id AS doc_id, turn::INTEGER AS page, i - 1 AS line_no, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS text
 FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)
 WHERE trim(regexp_replace(l[i], '\s+', ' ', 'g')) <> ''"""
_NEAREST_SQL = f"""
WITH c AS (SELECT doc_id, page, line_no, (line_no % 2) * 300.0::DOUBLE AS x0, ((line_no // 2) * 14 + (line_no % 2) * 3)::DOUBLE AS y0, length(text) AS n FROM ({_TURN_LINES_SQL})),
l AS (SELECT *, x0 + least(n * 6, 280) AS x1, y0 + 12 AS y1 FROM c),
p AS (SELECT a.doc_id, a.page, a.line_no, b.line_no AS next_no, greatest(b.y0 - a.y1, 0.0::DOUBLE) AS gap, b.y0 AS by0, b.x0 AS bx0 FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page = b.page
 AND b.y0 > a.y0 + 1e-6 AND greatest(b.y0 - a.y1, 0) <= 18 AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / greatest(least(a.x1 - a.x0, b.x1 - b.x0), 1e-9) >= 0.25)
SELECT doc_id, page, line_no::INTEGER AS line_no, next_no::INTEGER AS next_no, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY gap, by0, bx0, next_no) AS n FROM p) WHERE n = 1"""


def match_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of e-mail matches on a character grid: the words that a match overlaps."""
    lines = document_lines(table(spark, sf_dir, "documents")).withColumn("block_no", F.lit(0))
    hits = find_hits(lines.select(F.struct("doc_id", "page", "block_no", "line_no").alias("doc_id"), "page", "text"), preset_rules(["email"])).select("doc_id.*", "start", "end")
    hits = hits.withColumn("hit_id", F.col("start"))
    with_hits = lines.join(hits.select("doc_id", "page", "block_no", "line_no").distinct(), ["doc_id", "page", "block_no", "line_no"], "left_semi")
    words = grid_words(with_hits).withColumns({"start": (F.col("x0") / 6).cast("int"), "end": (F.col("x1") / 6).cast("int"), "horizontal": F.lit(True)})
    return match_boxes(hits, words).select("doc_id", "line_no", F.col("hit_id").alias("start_at"), "x0", "x1", "horizontal")


def proposals_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses in recognised words, mapped from the image to the page."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    words = grid_words(lines.join(lines.filter(F.contains("text", F.lit("@"))).select("doc_id").distinct(), "doc_id", "left_semi"))
    places = words.select("doc_id", "page").distinct().withColumn("transform", F.array(*[F.lit(x) for x in (0.5, 0.0, 0.0, 0.5, 100.0, 200.0)]))
    found = propose(words, places, preset_rules(["email"]))
    return found.groupBy("doc_id", "x0", "x1", "y0").agg(F.count("*").alias("n"), F.max("bucket").alias("bucket"))


_LINES = r"""(SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
_BOX_SQL = f"""SELECT doc_id, line_no::INTEGER AS line_no, start_at, 6.0::DOUBLE * (start_at - length(regexp_extract(substr(text, 1, start_at), '[^ ]*$'))) AS x0,
 6.0::DOUBLE * (end_at + length(regexp_extract(substr(text, end_at + 1), '^[^ ]*'))) AS x1, true AS horizontal FROM ({spans_sql(_LINES, EMAIL_SQL, 'doc_id, line_no')})"""


def partial_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of `tion` inside words, from the characters in reading order."""
    words = grid_words(document_lines(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn")).filter(F.contains("text", F.lit("tion")))
    words = words.withColumn("word_id", F.concat_ws("/", "line_no", "word_no"))
    at = F.position(F.lit("tion"), "text") - 1
    parts = words.select("doc_id", "page", "word_id", "text", *RECT, at.alias("from_char"), (at + 4).alias("to_char"))
    return partial_word_boxes(parts, grid_glyphs(words)).select("doc_id", "page", "word_id", "x0", "x1")


_PARTIAL_SQL = f"""SELECT doc_id, page, line_no || '/' || (k - 1) AS word_id, 6.0::DOUBLE * (pos + strpos(w[k], 'tion') - 1) AS x0, 6.0::DOUBLE * (pos + strpos(w[k], 'tion') + 3) AS x1
 FROM (SELECT *, coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x) + 1)), 0) AS pos FROM (SELECT doc_id, page, line_no, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM ({_TURN_LINES_SQL}))) WHERE contains(w[k], 'tion')"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of line items, with many repeats, in buckets by return flag."""
    bucket = F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "N", "search").otherwise("regex")
    x, y = F.floor(F.col("l_quantity") / 10) * 10.0, F.floor(F.col("l_discount") * 100) % 3
    rects = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), x.alias("x0"), (y * 20.0).alias("y0"), (x + 30).alias("x1"), (y * 20.0 + 12).alias("y1"), (F.col("l_linenumber") % 3 == 0).alias("horizontal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), bucket.alias("bucket"))
    return rects.withColumn("bucket", F.when((F.col("doc_id") % 7 == 0) & (F.col("bucket") == "regex"), "full_page").otherwise(F.col("bucket")))


_PLAN_SQL = """SELECT l_orderkey % 500 AS doc_id, (l_linenumber % 2)::INTEGER AS page, floor(l_quantity / 10) * 10.0::DOUBLE AS x0, (floor(l_discount * 100) % 3) * 20.0::DOUBLE AS y0, l_linenumber % 3 = 0 AS horizontal, l_orderkey * 10 + l_linenumber AS seq,
 CASE WHEN l_returnflag = 'A' THEN 'manual' WHEN l_returnflag = 'N' THEN 'search' WHEN l_orderkey % 500 % 7 = 0 THEN 'full_page' ELSE 'regex' END AS bucket FROM lineitem"""
_KEPT_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, x0, y0, bucket = 'full_page' ORDER BY CASE bucket WHEN 'manual' THEN 0 WHEN 'search' THEN 1 WHEN 'regex' THEN 2 ELSE 5 END, seq) AS n FROM ({_PLAN_SQL})) WHERE n = 1"


def plan_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(_plan(spark, sf_dir)).select("doc_id", "page", "x0", "y0", "bucket", "seq", "horizontal")


def plan_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_counts(_plan(spark, sf_dir)).select("doc_id", "n_manual", "n_search", "n_regex", "n_full_page", "n_total")


def plan_over_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_cap(_plan(spark, sf_dir), 30)


def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 1000
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long") % 5).alias("end"))
    return merge_ranges(ranges, ["l_suppkey"]).select("l_suppkey", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_RANGE_SQL = """
WITH r AS (SELECT l_suppkey, (l_partkey * 7 + l_linenumber * 13) % 1000 AS s, (l_partkey * 7 + l_linenumber * 13) % 1000 + l_quantity::BIGINT % 5 AS e FROM lineitem),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_suppkey, min(s) AS start_at, max(e) AS end_at FROM i GROUP BY l_suppkey, island"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of orders."""
    k = F.col("o_orderkey")
    x, y = (k % 300).cast("double"), (k * 7 % 500).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("region_id"), (F.col("o_custkey") % 200).alias("doc_id"), (k % 4).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + 20 + k % 50).alias("x1"), (y + 30.0).alias("y1"),
        F.when(k % 17 != 0, F.col("o_orderpriority")).alias("digest"), F.array((F.lit(20) + k % 50).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(30.0), x, y).alias("transform"),
    )


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large rectangles of suppliers; some are only proposals."""
    k = F.col("s_suppkey")
    x, y = (k * 31 % 100).cast("double"), (k * 53 % 200).cast("double")
    return table(spark, sf_dir, "supplier").select((k % 200).alias("doc_id"), (k % 4).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + 250).alias("x1"), (y + 250).alias("y1"), F.lit(False).alias("horizontal"), F.when(k % 3 == 0, "ocr").otherwise("manual").alias("bucket"), k.alias("seq"))


_REGIONS_SQL = "SELECT o_orderkey AS region_id, o_custkey % 200 AS doc_id, (o_orderkey % 4)::INTEGER AS page, (o_orderkey % 300)::DOUBLE AS x0, (o_orderkey * 7 % 500)::DOUBLE AS y0, (o_orderkey % 300 + 20 + o_orderkey % 50)::DOUBLE AS x1, (o_orderkey * 7 % 500 + 30)::DOUBLE AS y1, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS digest FROM orders"
_COVER_SQL = "SELECT s_suppkey % 200 AS doc_id, (s_suppkey % 4)::INTEGER AS page, (s_suppkey * 31 % 100)::DOUBLE AS x0, (s_suppkey * 53 % 200)::DOUBLE AS y0, (s_suppkey * 31 % 100 + 250)::DOUBLE AS x1, (s_suppkey * 53 % 200 + 250)::DOUBLE AS y1, CASE WHEN s_suppkey % 3 = 0 THEN 'ocr' ELSE 'manual' END AS bucket FROM supplier"


def regions_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncovered_regions(_regions(spark, sf_dir), _cover(spark, sf_dir)).select("region_id", "doc_id", "page")


def regions_unacknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir)
    off = F.when(F.col("region_id") % 10 == 0, 1.5).otherwise(0.5)
    acks = regions.filter(F.col("region_id") % 5 == 0).select("doc_id", "page", *[(F.col(c) + off).alias(c) for c in RECT])
    return unacknowledged_regions(regions, acks).select("region_id", "doc_id", "page")


_ACKS_SQL = f"SELECT doc_id, page, x0 + o AS x0, y0 + o AS y0, x1 + o AS x1, y1 + o AS y1 FROM (SELECT *, CASE WHEN region_id % 10 = 0 THEN 1.5 ELSE 0.5 END AS o FROM ({_REGIONS_SQL}) WHERE region_id % 5 = 0)"


def regions_covered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_parts(_regions(spark, sf_dir), _cover(spark, sf_dir)).select("region_id", "source", "u_x0", "u_y0", "u_x1", "u_y1")


_PARTS_SQL = f"""SELECT region_id, source, u_x0, u_y0, u_x1, u_y1 FROM (SELECT region_id, CASE WHEN bucket = 'ocr' THEN 'ocr' ELSE 'manual' END AS source,
 round(least(greatest((p.x0 - r.x0) / (r.x1 - r.x0), 0), 1), 5) AS u_x0, round(least(greatest((p.y0 - r.y0) / (r.y1 - r.y0), 0), 1), 5) AS u_y0,
 round(least(greatest((p.x1 - r.x0) / (r.x1 - r.x0), 0), 1), 5) AS u_x1, round(least(greatest((p.y1 - r.y0) / (r.y1 - r.y0), 0), 1), 5) AS u_y1
 FROM ({_REGIONS_SQL}) r JOIN ({_COVER_SQL}) p ON r.doc_id = p.doc_id AND r.page = p.page) WHERE u_x1 > u_x0 AND u_y1 > u_y0"""


def regions_review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir)
    # Written between the two, as generated code for both together grows too large.
    parts = materialize(covered_parts(regions, _cover(spark, sf_dir)).select("region_id", "source", "u_x0", "u_y0", "u_x1", "u_y1"), "covered-parts")
    groups = review_groups(regions.select("region_id", "doc_id", "page", "digest"), parts)
    return groups.select("doc_id", "digest", "n_members", F.array_join("pages", ",").alias("pages"), "first_region")


_GROUPS_SQL = f"""
WITH c AS (SELECT region_id, string_agg(source || ':' || u_x0 || ':' || u_y0 || ':' || u_x1 || ':' || u_y1, ';' ORDER BY u_x0, u_y0, u_x1, u_y1, source) AS covered FROM ({_PARTS_SQL}) GROUP BY region_id),
k AS (SELECT r.*, coalesce(covered, '') AS covered, CASE WHEN digest IS NULL THEN region_id END AS own FROM ({_REGIONS_SQL}) r LEFT JOIN c USING (region_id))
SELECT doc_id, digest, count(*) AS n_members, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT unnest(list(page + 1)) AS p)) AS pages, min(region_id) AS first_region FROM k GROUP BY doc_id, digest, covered, own"""


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 300).alias("doc_id"), (k % 3).cast("int").alias("page"), F.concat(F.lit("F"), (k % 11).cast("string")).alias("name"), F.when(k % 4 == 0, "Type3").otherwise("Type0").alias("subtype"), F.when(k % 3 == 0, "Identity-H").when(k % 3 == 1, "WinAnsi").alias("encoding"), (k % 5 == 0).alias("has_tounicode"))


_FONTS_SQL = """SELECT DISTINCT p_partkey % 300 AS doc_id, (p_partkey % 3)::INTEGER AS page, 'F' || (p_partkey % 11) AS name FROM part WHERE (p_partkey % 4 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0"""


def fonts_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreliable fonts of pages neither covered nor acknowledged."""
    fonts = unreliable_fonts(_fonts(spark, sf_dir))
    pages = fonts.select("doc_id", "page").distinct().withColumns({"width": F.lit(200.0), "height": F.lit(200.0)})
    acked = table(spark, sf_dir, "labels").filter("toxic = 1").select((F.col("doc_id") % 300).alias("doc_id"), F.lit(1).alias("page"))
    return unacknowledged_fonts(uncovered_fonts(fonts, _cover(spark, sf_dir), pages), acked).select("doc_id", "page", "name")


_FONTS_LEFT_SQL = f"""SELECT f.* FROM ({_FONTS_SQL}) f WHERE NOT EXISTS (SELECT 1 FROM ({_COVER_SQL}) p WHERE p.bucket = 'manual' AND p.doc_id = f.doc_id AND p.page = f.page AND p.x0 <= 2 AND p.y0 <= 2 AND p.x1 >= 198 AND p.y1 >= 198)
 AND NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND labels.doc_id % 300 = f.doc_id AND f.page = 1)"""


def region_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir)
    images = regions.select("doc_id", "page", F.col("region_id").alias("image_no"), *RECT, "digest")
    sizes = regions.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(6000.0) + F.col("doc_id") * 10.0})
    return image_regions(images, sizes, _cover(spark, sf_dir)).select("image_no", F.round("page_share", 8).alias("page_share"), F.round("text_ratio", 8).alias("text_ratio"))


_SHARES_SQL = f"""SELECT region_id AS image_no, round(any_value(share), 8) AS page_share, round(coalesce(sum(greatest(least(r.x1, p.x1) - greatest(r.x0, p.x0), 0) * greatest(least(r.y1, p.y1) - greatest(r.y0, p.y0), 0)) FILTER (WHERE p.doc_id IS NOT NULL), 0) / any_value(area), 8) AS text_ratio
 FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area, (x1 - x0) * (y1 - y0) / (600.0::DOUBLE * (6000.0::DOUBLE + doc_id * 10.0::DOUBLE)) AS share FROM ({_REGIONS_SQL})) r LEFT JOIN ({_COVER_SQL}) p ON r.doc_id = p.doc_id AND r.page = p.page WHERE share >= 0.0002 GROUP BY region_id"""


def image_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _cover(spark, sf_dir).withColumn("bucket", F.when(F.col("seq") % 10 == 0, "full_page").otherwise(F.col("bucket")))
    return redact_images(_regions(spark, sf_dir), plan, "pixels").select("region_id", "action")


_ACTIONS_SQL = f"""SELECT region_id, CASE WHEN max(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) = 1 THEN 'drop' WHEN max(CASE WHEN p.x0 IS NOT NULL AND least(r.x1, p.x1) > greatest(r.x0, p.x0) AND least(r.y1, p.y1) > greatest(r.y0, p.y0) THEN 1 ELSE 0 END) = 1 THEN 'blacken' ELSE 'keep' END AS action
 FROM ({_REGIONS_SQL}) r LEFT JOIN (SELECT *, s_suppkey AS k FROM supplier JOIN ({_COVER_SQL.replace('SELECT ', 'SELECT s_suppkey AS kk, ', 1)}) ON kk = s_suppkey) p ON r.doc_id = p.doc_id AND r.page = p.page GROUP BY region_id"""


def glyphs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of turns that a plan of rectangles leaves, per page."""
    glyphs = grid_glyphs(grid_words(document_lines(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn")))
    pages = turns(spark, sf_dir).select("doc_id", "page")
    plan = pages.select("doc_id", "page", (F.col("doc_id") % 20 * 6 + 3).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("doc_id") % 20 * 6 + 51).cast("double").alias("x1"), F.lit(26.0).alias("y1"), F.when(F.col("doc_id") % 9 == 0, "full_page").otherwise("manual").alias("bucket"))
    return redact_glyphs(glyphs, plan).groupBy("doc_id", "page").agg(F.count("*").alias("n_left"))


_GLYPHS_SQL = f"""SELECT doc_id, page, count(*) AS n_left FROM (SELECT doc_id, page, line_no, (i - 1) * 6 AS x, substr(text, i, 1) AS c FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM ({_TURN_LINES_SQL})))
 WHERE c <> ' ' AND doc_id % 9 <> 0 AND NOT (line_no * 14 < 26 AND x < doc_id % 20 * 6 + 51 AND x + 6 > doc_id % 20 * 6 + 3) GROUP BY doc_id, page"""


def rect_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    y0, y1 = F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber") * 4.0
    top, bottom = tightened(y0, y1, F.col("l_linenumber") % 2 == 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(top, 6).alias("y0"), F.round(bottom, 6).alias("y1"))


_TIGHTEN_SQL = """SELECT l_orderkey, l_linenumber, round(CASE WHEN a THEN m - t / 2 ELSE y0 END, 6) AS y0, round(CASE WHEN a THEN m + t / 2 ELSE y1 END, 6) AS y1
 FROM (SELECT *, l_linenumber % 2 = 1 AND h > 0 AND h <= 24 AND t < h AS a FROM (SELECT *, (y0 + y1) / 2 AS m, y1 - y0 AS h, least(greatest(0.6::DOUBLE * (y1 - y0), 3), 12) AS t FROM (SELECT l_orderkey, l_linenumber, l_quantity AS y0, l_quantity + l_linenumber * 4.0::DOUBLE AS y1 FROM lineitem)))"""


def affine_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes mapped there and back; the map is singular for some rows."""
    m = F.array((F.col("l_linenumber") - 2).cast("double"), F.lit(0.5), F.lit(0.0), F.lit(2.0), F.col("l_quantity"), F.lit(7.0))
    there = mapped_rect(m, F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(10.0))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inverse_map(m).alias("inv"), *[v.alias(k) for k, v in there.items()])
    back = mapped_rect(F.col("inv"), *[F.col(c) for c in RECT])
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in RECT], (F.round(back["x0"], 6) + 0.0).alias("back_x0"), (F.round(back["y1"], 6) + 0.0).alias("back_y1"))


_AFFINE_SQL = """
WITH m AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 2)::DOUBLE AS a, 0.5::DOUBLE AS b, 2.0::DOUBLE AS d, l_quantity AS e, 7.0::DOUBLE AS f, l_quantity AS w FROM lineitem),
r AS (SELECT *, least(e, a * w + e) AS x0, f AS y0, greatest(e, a * w + e) AS x1, b * w + d * 10 + f AS y1 FROM m),
i AS (SELECT *, CASE WHEN abs(a * d) >= 1e-9 THEN 1 END AS ok FROM r)
SELECT l_orderkey, l_linenumber, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1,
 CASE WHEN ok = 1 THEN round(least((x0 - e) / a, (x1 - e) / a), 6) + 0.0::DOUBLE END AS back_x0,
 CASE WHEN ok = 1 THEN round(greatest(-b / (a * d) * x0 + y1 / d + (b * e - a * f) / (a * d), -b / (a * d) * x1 + y1 / d + (b * e - a * f) / (a * d)), 6) + 0.0::DOUBLE END AS back_y1 FROM i"""


def rect_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") - F.col("l_linenumber") * 5.0, F.col("l_linenumber") * 1.0]
    n = normalized(*a)
    outer = [F.lit(5.0), F.lit(0.0), F.lit(40.0), F.lit(4.0)]
    box = [n[c] for c in RECT]
    return table(spark, sf_dir, "lineitem").groupBy(
        contains_rect(outer, box, 0.75).alias("inside"), is_horizontal(F.col("l_discount") - 0.05).alias("horizontal"), (overlap_ratio(box[0], box[2], outer[0], outer[2]) >= 0.25).alias("overlaps")
    ).agg(F.count("*").alias("n"))


_PREDICATES_SQL = """SELECT x0 >= 4.25 AND x1 <= 40.75 AND y1 <= 4.75 AS inside, abs(l_discount - 0.05::DOUBLE) <= 1e-3 AS horizontal, greatest(least(x1, 40) - greatest(x0, 5), 0) / greatest(least(x1 - x0, 35), 1e-9) >= 0.25 AS overlaps, count(*) AS n
 FROM (SELECT l_discount, l_quantity - l_linenumber * 5.0::DOUBLE AS x0, l_quantity AS x1, l_linenumber * 1.0::DOUBLE AS y1 FROM lineitem) GROUP BY ALL"""


def dense_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3000 overlapping lines on one page: each with the nearest one below it."""
    k = F.col("id")
    lines = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block_no"), k.cast("int").alias("line_no"), F.lit("x").alias("text"), F.lit(50.0).alias("x0"), (k * 0.25).alias("y0"), F.lit(300.0).alias("x1"), (k * 0.25 + 10).alias("y1"))
    pairs = nearest_next_lines(lines)
    return pairs.select(F.col("a_line_no").alias("line_no"), F.col("b_line_no").alias("next_no"))


def many_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5000 rectangles on one page of 60000 characters: what is left of it."""
    k = F.col("id")
    glyphs = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.lit("x").alias("c"), ((k % 300) * 2).cast("double").alias("x0"), (F.floor(k / 300) * 4).cast("double").alias("y0"), ((k % 300) * 2 + 2).cast("double").alias("x1"), (F.floor(k / 300) * 4 + 4).cast("double").alias("y1"))
    plan = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), (k * 7 % 600).cast("double").alias("x0"), (k * 13 % 800).cast("double").alias("y0"), (k * 7 % 600 + 3).cast("double").alias("x1"), (k * 13 % 800 + 3).cast("double").alias("y1"), F.lit("manual").alias("bucket"))
    return redact_glyphs(glyphs, plan).groupBy("y0").agg(F.count("*").alias("n_left"))


_MANY_SQL = """SELECT y0, count(*) AS n_left FROM (SELECT (i % 300 * 2)::DOUBLE AS x0, (i // 300 * 4)::DOUBLE AS y0 FROM range(60000) t(i)) g
 WHERE NOT EXISTS (SELECT 1 FROM (SELECT k * 7 % 600 AS x, k * 13 % 800 AS y FROM range(5000) t(k)) p WHERE p.x < g.x0 + 2 AND p.x + 3 > g.x0 AND p.y < g.y0 + 4 AND p.y + 3 > g.y0) GROUP BY y0"""


ENTRIES = {
    "proposals_from_words": Entry(proposals_from_words, f"SELECT doc_id, x0 * 0.5::DOUBLE + 100 AS x0, x1 * 0.5::DOUBLE + 100 AS x1, line_no * 7.0::DOUBLE + 200 AS y0, count(*) AS n, 'ocr' AS bucket FROM (SELECT DISTINCT * FROM ({_BOX_SQL})) GROUP BY ALL"),
    "dense_page_lines": Entry(dense_page_lines, "SELECT i::INTEGER AS line_no, (i + 1)::INTEGER AS next_no FROM range(2999) t(i)"),
    "many_rectangles": Entry(many_rectangles, _MANY_SQL),
    "letterspace_runs": Entry(letterspace_runs, f"SELECT doc_id, count(*) FILTER (WHERE glued) AS n_glued, count(*) AS n_words FROM ({_RUNS_SQL}) GROUP BY doc_id"),
    "letterspaced_lines": Entry(
        letterspaced_lines,
        f"SELECT t.doc_id, t.text, b.x0, b.x1, b.n::INTEGER AS n_spans, length(t.text)::INTEGER AS last_end FROM (SELECT doc_id, string_agg(CASE WHEN i = 0 OR glued THEN '' ELSE ' ' END || text, '' ORDER BY i) AS text FROM ({_RUNS_SQL}) GROUP BY doc_id) t JOIN (SELECT doc_id, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1, count(*) AS n FROM ({_LETTERS_SQL}) GROUP BY doc_id) b USING (doc_id)",
    ),
    "nearest_next_lines": Entry(nearest_next, _NEAREST_SQL),
    "match_word_boxes": Entry(match_word_boxes, _BOX_SQL),
    "partial_word_boxes": Entry(partial_words, _PARTIAL_SQL),
    "plan_dedupe": Entry(plan_dedupe, f"SELECT doc_id, page, x0, y0, bucket, seq, horizontal FROM ({_KEPT_SQL})"),
    "plan_bucket_counts": Entry(
        plan_bucket_counts,
        f"SELECT * FROM (SELECT doc_id, count(*) FILTER (WHERE bucket = 'manual') AS n_manual, count(*) FILTER (WHERE bucket = 'search') AS n_search, count(*) FILTER (WHERE bucket = 'regex') AS n_regex, count(*) FILTER (WHERE bucket = 'full_page') AS n_full_page FROM ({_PLAN_SQL}) GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS n_total FROM ({_KEPT_SQL}) GROUP BY doc_id) USING (doc_id)",
    ),
    "plan_over_cap": Entry(plan_over_cap, f"SELECT doc_id, count(*) AS n_rects FROM ({_PLAN_SQL}) WHERE bucket IN ('manual', 'full_page') GROUP BY doc_id HAVING count(*) > 30"),
    "range_merge": Entry(range_merge, _RANGE_SQL),
    "regions_uncovered": Entry(
        regions_uncovered,
        f"SELECT region_id, doc_id, page FROM ({_REGIONS_SQL}) r WHERE x1 - x0 > 4 AND y1 - y0 > 4 AND NOT EXISTS (SELECT 1 FROM ({_COVER_SQL}) p WHERE p.bucket = 'manual' AND p.doc_id = r.doc_id AND p.page = r.page AND r.x0 + 2 >= p.x0 AND r.y0 + 2 >= p.y0 AND r.x1 - 2 <= p.x1 AND r.y1 - 2 <= p.y1)",
    ),
    "regions_unacknowledged": Entry(
        regions_unacknowledged,
        f"SELECT region_id, doc_id, page FROM ({_REGIONS_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM ({_ACKS_SQL}) a WHERE a.doc_id = r.doc_id AND a.page = r.page AND abs(a.x0 - r.x0) <= 1 AND abs(a.y0 - r.y0) <= 1 AND abs(a.x1 - r.x1) <= 1 AND abs(a.y1 - r.y1) <= 1)",
    ),
    "regions_covered_parts": Entry(regions_covered_parts, _PARTS_SQL),
    "regions_review_groups": Entry(regions_review_groups, _GROUPS_SQL),
    "fonts_unread": Entry(fonts_unread, _FONTS_LEFT_SQL),
    "region_shares": Entry(region_shares, _SHARES_SQL),
    "image_actions": Entry(image_actions, _ACTIONS_SQL),
    "glyphs_left": Entry(glyphs_left, _GLYPHS_SQL),
    "rect_tighten": Entry(rect_tighten, _TIGHTEN_SQL),
    "affine_maps": Entry(affine_maps, _AFFINE_SQL),
    "rect_predicates": Entry(rect_predicates, _PREDICATES_SQL),
}
