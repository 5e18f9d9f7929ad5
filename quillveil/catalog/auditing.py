"""Queries over audits: two readers, caps, verdicts, coverage, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.catalog.common import BREAK_SQL, EMAIL_SQL, Entry, documents, table, turns
from quillveil.operators.audit import READERS, audit_pages, cap_report, diagnosis, leaks_by_rule, matched_pages, merge_readers, reader_status, scan_view
from quillveil.operators.unread import preview_side
from quillveil.operators.verdict import coverage, gate, http_status
from quillveil.plans.redaction import redact
from quillveil.plans.rules import Rule, preset_rules, search_rule
from quillveil.streaming.liveness import idle_sessions

_PHRASE = Rule("search:0", "search", r"\. the", True)
_WORD = "len(list_filter(regexp_split_to_array(lower(text), '" + BREAK_SQL + "+'), lambda x: x = 'the'))"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def audit_two_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a phrase by reading: the collapsed one sees it across line breaks."""
    found = audit_pages(documents(spark, sf_dir), [_PHRASE])
    return found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.count(F.when(F.size("seen_by") == 2, 1)).alias("n_both"), F.count(F.when(F.array_contains("seen_by", READERS[1]) & (F.size("seen_by") == 1), 1)).alias("n_plain_only"))


def audit_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches shown per conversation, turns being its pages."""
    shown = cap_report(scan_view(turns(spark, sf_dir), [search_rule("the", ignore_accents=False)], READERS[0]), ["doc_id"], most=5)
    return shown.groupBy("doc_id", "page").agg(F.count("*").alias("n_shown"))


def audit_matched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched_pages(scan_view(turns(spark, sf_dir), [search_rule("the", ignore_accents=False)], READERS[0]), ["doc_id"])
    return found.select("doc_id", F.array_join("pages", ",").alias("pages"), "n_matches")


def audit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [search_rule("the", "search:0", ignore_accents=False), *preset_rules(["email"])]
    found = leaks_by_rule(scan_view(turns(spark, sf_dir), rules, READERS[0]))
    return found.select("doc_id", "rule_id", "n_matches", F.size("details").alias("n_details"))


def audit_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis(scan_view(documents(spark, sf_dir), [search_rule("of the", ignore_accents=False)], READERS[0]))
    return found.select("doc_id", "diagnosis")


def verdict_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses found, cut out, and looked for again by two readers."""
    verdict = redact(documents(spark, sf_dir), preset_rules(["email"])).verdict
    return verdict.select("doc_id", "status", "coverage", "total_matches", F.array_join("components_failed", ",").alias("failed"))


def verdict_after_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses are cut, a phrase that nobody cut is banned: its documents fail."""
    verdict = redact(documents(spark, sf_dir), preset_rules(["email"]), [_PHRASE]).verdict
    return verdict.select("doc_id", "status", "total_matches")


_MERGED = rf"""SELECT doc_id, least(a, 50) AS a, least(b, 50) AS b FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)\. the')) AS a, len(regexp_extract_all({_FLAT}, '(?i)\. the')) AS b FROM %s)"""
_CUT = f"(SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '', 'g') AS text FROM documents)"


def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of rules, mode and unread parts that the labels give."""
    mode = F.when(F.col("doc_id") % 3 == 0, "ignore").when(F.col("doc_id") % 3 == 1, "review").otherwise("block")
    unread, left = (F.col("quality") + F.col("toxic")).cast("long"), F.col("toxic").cast("long")
    rows = table(spark, sf_dir, "labels").select("doc_id", mode.alias("mode"), unread.alias("n_unread"), left.alias("n_left"), (F.col("doc_id") % 5 != 0).alias("textual"), (F.col("doc_id") % 7 != 0).alias("checked"))
    may = gate(F.col("mode"), F.col("n_unread"), F.col("n_left"))
    status = F.when(~may, "inconclusive").otherwise("pass")
    return rows.select("doc_id", may.alias("may_go"), coverage(F.col("textual"), F.col("checked"), F.col("n_unread"), F.col("mode")).alias("coverage"), http_status(status).alias("code"))


_COVERAGE_SQL = """SELECT doc_id, may AS may_go, CASE WHEN doc_id % 5 = 0 THEN 'complete' WHEN doc_id % 7 = 0 THEN 'skipped' WHEN quality + toxic = 0 THEN 'complete' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'acknowledged' END AS coverage, CASE WHEN may THEN 200 ELSE 409 END AS code
 FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 2 THEN quality + toxic = 0 ELSE toxic = 0 END AS may FROM labels)"""


def reader_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_linestatus") == "F", "failed").otherwise("empty")
    return reader_status(lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("reader_no"), status.alias("status")).dropDuplicates(["doc_id", "reader_no"]).join(lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d")).filter("n = d").select("doc_id"), "doc_id", "left_semi"))


_STATUS_SQL = """SELECT doc_id, coalesce(arg_min(status, reader_no) FILTER (WHERE status <> 'ok'), 'ok') AS status, count(*) FILTER (WHERE status = 'ok') = 0 AS unreadable
 FROM (SELECT l_orderkey AS doc_id, l_linenumber AS reader_no, CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'empty' END AS status FROM lineitem
 WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber))) GROUP BY doc_id"""


def readers_one_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that sees nothing changes no verdict: the other's matches stand."""
    first = scan_view(documents(spark, sf_dir), preset_rules(["email"]), READERS[0])
    merged = merge_readers(first.filter("false"), first.withColumn("reader", F.lit(READERS[1])))
    return merged.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.max(F.array_join("seen_by", ",")).alias("seen_by"))


def preview_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey")).alias("doc_id")).agg(F.countDistinct("o_orderdate").alias("n_images"))
    return counted.select("doc_id", "n_images", preview_side(F.col("n_images")).alias("side"))


def idle_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle_sessions(table(spark, sf_dir, "events"), silence=3600).select("user_id", F.col("session_no").alias("session_no"), "first_ts", "last_ts", "n_events")


_IDLE_SQL = """
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM n GROUP BY user_id, session_no"""


ENTRIES = {
    "audit_two_readers": Entry(audit_two_readers, f"SELECT doc_id, greatest(a, b)::BIGINT AS n_matches, least(a, b)::BIGINT AS n_both, greatest(b - a, 0)::BIGINT AS n_plain_only FROM ({_MERGED % 'documents'}) WHERE greatest(a, b) > 0"),
    "audit_caps": Entry(
        audit_caps,
        f"SELECT doc_id, page, least(c, 5 - coalesce(before, 0))::BIGINT AS n_shown FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT conv_id AS doc_id, turn::INTEGER AS page, least({_WORD}, 50) AS c FROM conversations) WHERE c > 0) WHERE coalesce(before, 0) < 5",
    ),
    "audit_matched_pages": Entry(audit_matched_pages, f"SELECT doc_id, string_agg((page + 1)::VARCHAR, ',' ORDER BY page) AS pages, sum(c)::BIGINT AS n_matches FROM (SELECT conv_id AS doc_id, turn::INTEGER AS page, least({_WORD}, 50) AS c FROM conversations) WHERE c > 0 GROUP BY doc_id"),
    "audit_leaks": Entry(
        audit_leaks,
        f"""SELECT doc_id, rule_id, sum(n)::BIGINT AS n_matches, least(sum(n), 50)::INTEGER AS n_details FROM (SELECT conv_id AS doc_id, 'search:0' AS rule_id, least({_WORD}, 50) AS n FROM conversations
UNION ALL SELECT conv_id, 'preset:email', least(len(regexp_extract_all(text, '{EMAIL_SQL}')), 50 - least({_WORD}, 50)) FROM conversations) WHERE n > 0 GROUP BY ALL""",
    ),
    "audit_diagnosis": Entry(
        audit_diagnosis,
        rf"SELECT doc_id, CASE WHEN n > 0 THEN 'line_break_split' END AS diagnosis FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(?:^|{BREAK_SQL})of\s+the(?:$|{BREAK_SQL})')[1:50], lambda x: contains(regexp_extract(x, '(?i)of\s+the'), chr(10)))) AS n, text FROM documents) WHERE regexp_matches(text, '(?i)(?:^|{BREAK_SQL})of\s+the(?:$|{BREAK_SQL})')",
    ),
    "verdict_per_document": Entry(
        verdict_per_document,
        f"SELECT doc_id, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, 'complete' AS coverage, n::BIGINT AS total_matches, CASE WHEN n > 0 THEN 'preset' ELSE '' END AS failed FROM (SELECT doc_id, least(greatest(len(regexp_extract_all(text, '{EMAIL_SQL}')), len(regexp_extract_all({_FLAT}, '{EMAIL_SQL}'))), 50) AS n FROM {_CUT})",
    ),
    "verdict_after_partial": Entry(verdict_after_partial, f"SELECT doc_id, CASE WHEN greatest(a, b) > 0 THEN 'fail' ELSE 'pass' END AS status, greatest(a, b)::BIGINT AS total_matches FROM ({_MERGED % _CUT})"),
    "coverage_levels": Entry(coverage_levels, _COVERAGE_SQL),
    "reader_statuses": Entry(reader_statuses, _STATUS_SQL),
    "readers_one_blind": Entry(readers_one_blind, f"SELECT doc_id, least(n, 50)::BIGINT AS n_matches, 'plain' AS seen_by FROM (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents) WHERE n > 0"),
    "preview_sizes": Entry(preview_sizes, "SELECT doc_id, n_images, CASE WHEN n_images <= 4 THEN 1600 WHEN n_images <= 10 THEN 1200 WHEN n_images <= 20 THEN 900 ELSE 700 END AS side FROM (SELECT o_custkey AS doc_id, count(DISTINCT o_orderdate) AS n_images FROM orders GROUP BY o_custkey)"),
    "idle_sessions": Entry(idle_session_list, _IDLE_SQL),
}
