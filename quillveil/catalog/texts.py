"""Queries over text: detectors, searches, rules, lines, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.catalog.common import BREAK_SQL, CARD_SQL, EMAIL_SQL, PHONE_SQL, Entry, documents, spans_sql, table, turns
from quillveil.functions import detectors as D
from quillveil.functions.folding import fold_column
from quillveil.functions.html import patterns, sanitized
from quillveil.functions.reports import header_value
from quillveil.functions.text import match_spans, shorten
from quillveil.operators.apply import redact_native, redact_text
from quillveil.operators.audit import with_evidence
from quillveil.operators.layout import document_lines
from quillveil.operators.matching import documents_with_literals, find_hits, next_lines, pair_hits
from quillveil.plans.redaction import run_request
from quillveil.plans.rules import Rule, parse_request, preset_rules, regex_rules, search_rule


def _hits(pages: DataFrame, *rules: Rule) -> DataFrame:
    return find_hits(pages, list(rules)).withColumnsRenamed({"start": "start_at", "end": "end_at"})


def _count(pages: DataFrame, rule: Rule) -> DataFrame:
    return find_hits(pages, [rule]).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def email_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(documents(spark, sf_dir), *preset_rules(["email"])).select("doc_id", "start_at", "end_at", "match")


def email_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.size(match_spans(F.col("text"), D.JAVA_FLAGS + D.EMAIL)).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.sum("n").alias("n_hits"))


def card_hits_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(documents(spark, sf_dir), *preset_rules(["card"])).select("doc_id", "start_at", "end_at", "match")


_LUHN_SQL = """(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1
 THEN 2 * substr(d, i, 1)::INTEGER - CASE WHEN substr(d, i, 1)::INTEGER > 4 THEN 9 ELSE 0 END ELSE substr(d, i, 1)::INTEGER END)) % 10 = 0)"""


def phone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(D.JAVA_FLAGS + D.PHONE), F.lit(0))).alias("m"))
    return found.groupBy("doc_id", F.trim("m").alias("candidate")).agg(F.count("*").alias("n_hits"))


def phone_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National candidates by two plans; those with a plus are tested on a table of numbers (tests/test_detectors.py)."""
    found = phone_candidates(spark, sf_dir).withColumn("normalized", D.phone_normalized(F.col("candidate"))).filter("NOT startswith(normalized, '+')")
    return found.select("doc_id", "candidate", "normalized", D.phone_ok(F.col("candidate"), "FR").alias("ok_fr"), D.phone_ok(F.col("candidate"), "US").alias("ok_us"))


#: Rules of the two plans by digits, as the regulators state them: nine digits after the trunk 0 in France, ten in three parts in North America.
_FR_SQL = """(length(f) = 9 AND (substr(f, 1, 1) IN ('1', '2', '3', '4', '5', '6', '9') OR (substr(f, 1, 1) = '7' AND substr(f, 2, 1) >= '3') OR substr(f, 1, 2) = '80'))"""
_US_SQL = """(length(u) = 10 AND substr(u, 1, 1) >= '2' AND substr(u, 2, 1) <> '9' AND substr(u, 2, 2) <> '11' AND substr(u, 4, 1) >= '2' AND (substr(u, 1, 1) <> '5' OR substr(u, 1, 3) <> '555'))"""


PHONE_VALID_SQL = rf"""
WITH c AS (SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(text, '{PHONE_SQL}')), ' ' || chr(10)) AS candidate FROM documents),
w AS (SELECT doc_id, candidate, regexp_replace(trim(regexp_replace(candidate, '(?i)\b(?:ext\.?|extension|poste|x|#)\s*\d{{1,6}}\b', '', 'g')), '^\s*00', '+') AS whole FROM c),
n AS (SELECT doc_id, candidate, CASE WHEN starts_with(whole, '+') THEN '+' ELSE '' END || regexp_replace(whole, '\D', '', 'g') AS n FROM w),
p AS (SELECT *, CASE WHEN starts_with(n, '0') THEN substr(n, 2) ELSE n END AS f, CASE WHEN length(n) = 11 AND starts_with(n, '1') THEN substr(n, 2) ELSE n END AS u FROM n)
SELECT doc_id, candidate, n AS normalized, {_FR_SQL} AS ok_fr, {_US_SQL} AS ok_us FROM p WHERE NOT starts_with(n, '+')"""


def search_subword_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(documents(spark, sf_dir), search_rule("Tion", whole_word=False, ignore_accents=False))


def search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(documents(spark, sf_dir), search_rule("The", case_sensitive=True, whole_word=False, ignore_accents=False))


def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(documents(spark, sf_dir), search_rule("THE", ignore_accents=False))


def search_accent_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(documents(spark, sf_dir), search_rule("ère", whole_word=False))


def search_welded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(documents(spark, sf_dir), search_rule("est", whole_word=False, ignore_accents=False))


def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold_column(F.col("text"))).alias("digest"), F.length(fold_column(F.col("text"))).alias("n_chars"))


def multi_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of five words of every benchmark item as a rule, all in one pass over the documents: documents that hold any of an item's."""
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.array_join(F.slice(words, i + 1, F.lit(5)), " "))
    rules = table(spark, sf_dir, "benchmark").filter(F.size(words) >= 5).select(F.col("item_id").alias("literal_id"), F.explode(runs).alias("text"))
    found = documents_with_literals(documents(spark, sf_dir), rules)
    return found.groupBy(F.col("literal_id").alias("item_id")).agg(F.count("*").alias("n_docs"))


def search_rules_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 search rules in one pass: matches of each."""
    rules = [search_rule(w, f"search:{w}", whole_word=True, ignore_accents=False) for w in _WORDS_200]
    return find_hits(documents(spark, sf_dir), rules).groupBy("rule_id").agg(F.count("*").alias("n_hits"))


def search_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that ignore accents find decomposed letters as well: the texts are decomposed here first."""
    pages = documents(spark, sf_dir).withColumn("text", F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "é", "e\u0301"), "ó", "o\u0301"), "ñ", "n\u0303"))
    return _count(pages, search_rule("ción", whole_word=False))


def rules_with_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [search_rule("the", "a", ignore_accents=False, pages=[2, 0, 2]), search_rule("and", "b", ignore_accents=False, pages=[])]
    return find_hits(turns(spark, sf_dir), rules).groupBy("rule_id", F.col("page").cast("int").alias("page")).agg(F.count("*").alias("n_hits"))


def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size(F.split("text", " "))).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


_LINES_SQL = r"""SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS text
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
 WHERE trim(regexp_replace(l[i], '\s+', ' ', 'g')) <> ''"""


def line_pairs_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = next_lines(document_lines(table(spark, sf_dir, "documents")), ["line_no"])
    return pair_hits(pairs, Rule("search:0", "search", r"\.\s+(?:the|de|la|der)\b", True, multiline=True)).groupBy("doc_id").agg(F.count("*").alias("n_pairs"))


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir)
    out = redact_text(pages, find_hits(pages, preset_rules(["email"])))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "n_spans")


def redacted_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact_native(documents(spark, sf_dir), preset_rules(["email"]), "[x]")
    return out.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "n_spans")


def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir)
    found = with_evidence(find_hits(pages, preset_rules(["email"])), pages)
    return found.select("doc_id", "page", F.col("start").alias("start_at"), "snippet", "spans_line_break")


def html_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = sanitized(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("digest"))


def _sanitize_sql() -> str:
    sql = "html"
    for p in patterns():
        sql = "regexp_replace({}, '{}', '', 'g')".format(sql, p.replace("'", "''"))
    return sql


def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"text":"'), "text", F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", header_value(body).alias("h")).select("doc_id", F.md5("h.report").alias("digest"), "h.truncated")


def shortened_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", shorten(F.element_at(F.split("text", "\n"), 1)).alias("title"))


USER_PATTERNS = [r"(?<=\s)(\w+)ing(?=\s+\1)", r"\b(?:ré|de)\w+(?<!e)\b"]


def regex_user_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User patterns with lookaround, on Python's engine under a time budget."""
    rules = regex_rules(USER_PATTERNS, ignore_accents=False)
    return find_hits(documents(spark, sf_dir), rules, budget=600.0).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n_hits"))


def regex_word_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user pattern whose matches SQL can count by words."""
    rules = regex_rules(r"\bde\w+(?<!e)\b", ignore_accents=False)
    return find_hits(documents(spark, sf_dir), rules, budget=600.0).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def regex_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-line user pattern with a blank in it: also over the end of a line."""
    rules = regex_rules(r"[.] [A-Z]", ignore_accents=False, case_sensitive=True, multiline=True)
    return find_hits(documents(spark, sf_dir), rules, budget=600.0).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def regex_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user pattern whose accents do not count, neither in it nor in the text."""
    return find_hits(documents(spark, sf_dir), regex_rules(r"ci[oó]n\b"), budget=600.0).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def regex_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user pattern bound to whole words."""
    return find_hits(documents(spark, sf_dir), regex_rules("de|la", ignore_accents=False, whole_word=True), budget=600.0).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def banned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with a detector and a list of banned strings, found as parts of words and in their own case."""
    out = run_request(documents(spark, sf_dir), parse_request({"presets": {"keys": ["email", "credit_card"]}, "audit": {"patterns": ["License"]}, "options": {"image_regions": "ignore"}}))
    return out.verdict.select("doc_id", "status", F.array_join("components_failed", ",").alias("failed"))


def pages_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request that empties the second page of each document."""
    out = run_request(turns(spark, sf_dir), parse_request({"full_page_rects": [{"page": 1}]}))
    return out.redacted.select("doc_id", "page", F.md5("text").alias("digest"))


def regex_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that backtracks for ever ends with its budget of a second; the row says that it did."""
    pages = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.lit("a" * 40 + "!").alias("text"))
    try:
        find_hits(pages, regex_rules(r"(a|aa)+$"), budget=1.0).count()
        ended = False
    except Exception as e:  # what a task raises reaches the driver wrapped
        ended = "PatternTimeout" in str(e)
    return spark.range(1).select(F.lit(ended).alias("ended_by_budget"))


def detector_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.streaming.liveness import redact_stream

    out = redact_stream(table(spark, sf_dir, "documents").select("doc_id", "text"), ["email"])
    return out.select("doc_id", "n_hits", F.md5("text").alias("digest"), "status")


#: 200 words of two letters and more, for as many rules.
_WORDS_200 = [a + b + c for a in "bdlmnprst" for b in "aeiou" for c in ("", "n", "r", "s", "t")][:200]
_RAW_LINES_SQL = "SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(l[i]) <> ''"

ENTRIES = {
    "email_hits": Entry(email_hits, f"SELECT doc_id, start_at, end_at, \"match\" FROM ({spans_sql('documents', EMAIL_SQL)})"),
    "email_counts_by_lang": Entry(email_counts_by_lang, f"SELECT lang, count(*) FILTER (WHERE n > 0) AS n_docs, sum(n)::BIGINT AS n_hits FROM (SELECT lang, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents) GROUP BY lang"),
    "card_hits_luhn": Entry(card_hits_luhn, f"SELECT doc_id, start_at, end_at, \"match\" FROM (SELECT *, regexp_replace(\"match\", '\\D', '', 'g') AS d FROM ({spans_sql('documents', CARD_SQL)})) WHERE length(d) BETWEEN 13 AND 19 AND {_LUHN_SQL}"),
    "phone_candidates": Entry(phone_candidates, f"SELECT doc_id, candidate, count(*) AS n_hits FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{PHONE_SQL}')), ' ' || chr(10)) AS candidate FROM documents) GROUP BY ALL"),
    "phone_valid": Entry(phone_valid, PHONE_VALID_SQL),
    "search_subword_ci": Entry(search_subword_ci, "SELECT doc_id, len(regexp_extract_all(text, '(?i)tion')) AS n_hits FROM documents WHERE regexp_matches(text, '(?i)tion')"),
    "search_case_sensitive": Entry(search_case_sensitive, "SELECT doc_id, len(regexp_extract_all(text, 'The')) AS n_hits FROM documents WHERE contains(text, 'The')"),
    "search_whole_word": Entry(search_whole_word, rf"SELECT * FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: x = 'the')) AS n_hits FROM documents) WHERE n_hits > 0"),
    "search_accent_folded": Entry(search_accent_folded, "SELECT doc_id, len(regexp_extract_all(strip_accents(text), '(?i)ere')) AS n_hits FROM documents WHERE regexp_matches(strip_accents(text), '(?i)ere')"),
    "search_welded_letters": Entry(search_welded_letters, "SELECT doc_id, len(regexp_extract_all(text, '(?i)e(?:st|ﬆ)')) AS n_hits FROM documents WHERE regexp_matches(text, '(?i)e(?:st|ﬆ)')"),
    "folded_text": Entry(folded_text, "SELECT doc_id, md5(strip_accents(text)) AS digest, length(strip_accents(text))::INTEGER AS n_chars FROM documents"),
    "multi_rule_counts": Entry(
        multi_rule_counts,
        "SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM documents, (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS q FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)) b WHERE contains(documents.text, q) GROUP BY item_id",
    ),
    "search_rules_at_once": Entry(
        search_rules_at_once,
        rf"SELECT 'search:' || x AS rule_id, count(*) AS n_hits FROM (SELECT unnest(regexp_split_to_array(lower(text), '{BREAK_SQL}+')) AS x FROM documents) WHERE x IN ({', '.join(repr(w) for w in _WORDS_200)}) GROUP BY x",
    ),
    "search_decomposed": Entry(search_decomposed, "SELECT doc_id, len(regexp_extract_all(strip_accents(text), '(?i)cion')) AS n_hits FROM documents WHERE regexp_matches(strip_accents(text), '(?i)cion')"),
    "regex_word_ends": Entry(
        regex_word_ends,
        rf"SELECT * FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: starts_with(x, 'de') AND length(x) > 2 AND NOT ends_with(x, 'e'))) AS n_hits FROM documents) WHERE n_hits > 0",
    ),
    "regex_over_lines": Entry(regex_over_lines, f"SELECT doc_id, len(regexp_extract_all(t, '[.][ \n][A-Z]')) AS n_hits FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM ({_RAW_LINES_SQL}) GROUP BY doc_id) WHERE regexp_matches(t, '[.][ \n][A-Z]')"),
    "regex_folded": Entry(regex_folded, rf"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(strip_accents(text), '(?i)cion(?:$|{BREAK_SQL})')) AS n_hits FROM documents) WHERE n_hits > 0"),
    "regex_whole_word": Entry(regex_whole_word, rf"SELECT * FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: x IN ('de', 'la'))) AS n_hits FROM documents) WHERE n_hits > 0"),
    "banned_text": Entry(banned_text, f"SELECT doc_id, CASE WHEN contains(r, 'License') THEN 'fail' ELSE 'pass' END AS status, CASE WHEN contains(r, 'License') THEN 'ban' ELSE '' END AS failed FROM (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '', 'g') AS r FROM documents)"),
    "pages_emptied": Entry(pages_emptied, "SELECT conv_id AS doc_id, turn::INTEGER AS page, md5(CASE WHEN turn = 1 THEN '' ELSE text END) AS digest FROM conversations"),
    "regex_over_budget": Entry(regex_over_budget, "SELECT true AS ended_by_budget"),
    "rules_with_scope": Entry(
        rules_with_scope,
        rf"""SELECT rule_id, page, sum(n)::BIGINT AS n_hits FROM (
SELECT 'a' AS rule_id, turn::INTEGER AS page, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: x = 'the')) AS n FROM conversations WHERE turn IN (0, 2)
UNION ALL SELECT 'b', turn::INTEGER, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: x = 'and')) FROM conversations) WHERE n > 0 GROUP BY ALL""",
    ),
    "lines_of_documents": Entry(lines_of_documents, f"SELECT doc_id, count(*) AS n_lines, sum(len(string_split(text, ' ')))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM ({_LINES_SQL}) GROUP BY doc_id"),
    "line_pairs_multiline": Entry(
        line_pairs_multiline,
        f"SELECT doc_id, count(*) AS n_pairs FROM (SELECT doc_id, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM ({_LINES_SQL})) WHERE text LIKE '%.' AND regexp_matches(nxt, '(?i)^(?:the|de|la|der)($|{BREAK_SQL})') GROUP BY doc_id",
    ),
    "redacted_text": Entry(redacted_text, f"SELECT doc_id, length(r)::INTEGER AS n_chars, md5(r) AS digest, n::INTEGER AS n_spans FROM (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '', 'g') AS r, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents)"),
    "redacted_in_row": Entry(redacted_in_row, f"SELECT doc_id, length(r)::INTEGER AS n_chars, md5(r) AS digest, n::INTEGER AS n_spans FROM (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[x]', 'g') AS r, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents)"),
    "match_snippets": Entry(
        match_snippets,
        f"SELECT doc_id, 1 AS page, start_at, replace(substr(text, greatest(start_at - 30, 0) + 1, end_at + 30 - greatest(start_at - 30, 0)), chr(10), '\\n') AS snippet, contains(\"match\", chr(10)) AS spans_line_break FROM ({spans_sql('documents', EMAIL_SQL)})",
    ),
    "html_sanitized": Entry(html_sanitized, f"SELECT page_id, length(h)::INTEGER AS n_chars, md5(h) AS digest FROM (SELECT page_id, {_sanitize_sql()} AS h FROM pages)"),
    "report_headers": Entry(
        report_headers,
        "SELECT doc_id, CASE WHEN length(b) <= 6000 THEN md5(b) END AS digest, length(b) > 6000 AS truncated FROM (SELECT doc_id, translate(to_base64(encode('{\"doc_id\":' || doc_id || ',\"text\":\"' || text || '\"}')), '+/', '-_') AS b FROM documents)",
    ),
    "shortened_titles": Entry(shortened_titles, "SELECT doc_id, CASE WHEN length(t) > 56 THEN substr(t, 1, 55) || '…' ELSE t END AS title FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS t FROM documents)"),
    "regex_user_rule": Entry(
        regex_user_rule,
        rf"""SELECT doc_id, 'regex:0' AS rule_id, count(*) AS n_hits FROM (SELECT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(range(2, len(t))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS t FROM documents)))
 WHERE regexp_full_match(lower(a), '[\pL\pM\pN\p{{Pc}}]+ing') AND starts_with(lower(b), lower(substr(a, 1, length(a) - 3))) GROUP BY doc_id
UNION ALL SELECT doc_id, 'regex:1', n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{BREAK_SQL}+'), lambda x: (starts_with(x, 'de') OR starts_with(x, 'ré')) AND length(x) > 2 AND NOT ends_with(x, 'e'))) AS n FROM documents) WHERE n > 0""",
    ),
    "detector_stream_rows": Entry(
        detector_stream_rows,
        f"SELECT doc_id, n::INTEGER AS n_hits, md5(r) AS digest, CASE WHEN regexp_matches(r, '{EMAIL_SQL}') THEN 'fail' ELSE 'pass' END AS status FROM (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '', 'g') AS r, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n FROM documents)",
    ),
}
