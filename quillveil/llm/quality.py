"""Quality rules: a threshold table compiled into one projection.

Each rule is a row of `RULES`: a measure, its least and its largest value. The
measures are ratios of counts of one text, and the counts are built-in array
and string functions, so a document is judged in a single pass over its row: no
shuffle, no user function, no state, and a long text or a common one costs
nothing but its own length.

Words are the runs of characters other than blank and control white space
(U+0009 to U+000D). The repeated three-word windows are found by sorting window
hashes that carry their place in the low bits, which sorts primitives; the few
windows whose high bits agree are then compared in full. Texts too long for the
place bits take the full comparison throughout.

Defined results: a null or empty text has no words, all counts are 0, it fails
the base rule; repeated rows and ids are judged each, rows without id too; equal
lines count from their second appearance; no text is too long; a measure equal
to a bound passes; an empty table gives no row; `apply_rules` keeps all columns
of its input, and a column of the same name as a measure is not touched, as
measures live in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by have from at or an not we you but he they which his",
    "de": "der die das und in zu den von mit ist des für sich dem nicht ein eine auf im es als auch werden an dass bei nach",
    "fr": "le la les de des et en un une du que est pour qui dans par sur pas au avec ce il sont plus ne se ou",
    "es": "el la los las de que y en un una por con para es del se no al lo como más su sus o este entre ha",
}
_SYMBOLS = "#*$%&|<>"
_MARKS = "#*$%&|<>!~^=_+@{}\\[\\]\\\\"
_PLACE_BITS = 21


@dataclass(frozen=True)
class Rule:
    """Passes where low <= measure <= high; a bound of None is open."""

    measure: str
    low: float | None
    high: float | None


#: The threshold table. Ratios are to words, characters or lines, as `measures` says.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("mark_ratio", None, 0.20),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.40),
    Rule("upper_ratio", None, 0.50),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of `text` are in a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more."""
    mask = (1 << _PLACE_BITS) - 1
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    places = F.sequence(F.lit(0), F.size(words) - 3)
    packed = F.array_sort(F.transform(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    high = lambda a, i: F.shiftright(F.get(a, i), _PLACE_BITS)

    def near(a: Column) -> Column:
        same = F.filter(a, lambda x, i: ((i > 0) & (high(a, i - 1) == F.shiftright(x, _PLACE_BITS))) | F.coalesce(high(a, i + 1) == F.shiftright(x, _PLACE_BITS), F.lit(False)))
        return F.transform(same, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))

    def exact(candidates: Column) -> Column:
        full = F.array_sort(F.transform(candidates, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
        return _let(full, lambda f: F.transform(F.filter(f, lambda x, k: ((k > 0) & (F.get(f, k - 1)["w"] == x["w"])) | F.coalesce(F.get(f, k + 1)["w"] == x["w"], F.lit(False))), lambda x: x["i"]))

    candidates = F.when(F.size(words) <= mask, _let(packed, near)).otherwise(places)
    covered = _let(candidates, lambda c: F.size(F.array_distinct(F.flatten(F.transform(exact(c), lambda i: F.array(i, i + 1, i + 2))))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered).cast("long")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_STOP_SET = sorted({w for line in STOP_WORDS.values() for w in line.split()})
_UPPER = "A-ZÀ-ÖØ-Þ"


def measures(text: Column) -> Column:
    """A struct of all counts and ratios of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def counted(parts: Column) -> Column:
        words, lines, body = parts["words"], parts["lines"], parts["text"]
        n = F.size(words).cast("long")
        chars = F.length(F.array_join(words, "")).cast("long")
        per_word = lambda c: c / F.greatest(n, F.lit(1))
        per_char = lambda c: c / F.greatest(chars, F.lit(1))
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(_STOP_SET)))
        duplicates = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            _count_of(body, _SYMBOLS).alias("n_symbols"),
            duplicates.alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            per_word(chars).alias("mean_word_chars"),
            per_char(_count_of(body, _SYMBOLS)).alias("symbol_ratio"),
            per_word(_count_of(body, _MARKS)).alias("mark_ratio"),
            per_word(stop).alias("stop_ratio"),
            (duplicates / F.greatest(F.size(lines), F.lit(1))).alias("dup_line_ratio"),
            per_char(_count_of(body, _UPPER)).alias("upper_ratio"),
        )

    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(F.struct(words.alias("words"), lines.alias("lines"), t.alias("text")), counted)


def base_failed(m: Column) -> Column:
    """The base rule: too short, or more than half of its words inside repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def compile_rules(rules: tuple[Rule, ...] = RULES):
    """A function from the struct of measures to one boolean expression: all rules pass."""

    def verdict(m: Column) -> Column:
        tests = [F.lit(True)]
        for r in rules:
            tests += [m[r.measure] >= r.low] * (r.low is not None) + [m[r.measure] <= r.high] * (r.high is not None)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "_quality") -> DataFrame:
    """The input with one more struct column: all measures, base_failed, rules_passed and kept."""
    verdict = compile_rules(rules)
    whole = lambda m: m.withField("base_failed", base_failed(m)).withField("rules_passed", verdict(m)).withField("kept", ~base_failed(m) & verdict(m))
    return docs.withColumn(out, _let(measures(F.col(text_col)), whole))


def score_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept and the ratios behind the verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_word_chars", "symbol_ratio", "mark_ratio", "stop_ratio", "dup_line_ratio", "upper_ratio")
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *[F.col("_quality")[n].alias(n) for n in names])


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    verdict = compile_rules(rules)
    return docs.filter(_let(measures(F.col(text_col)), lambda m: ~base_failed(m) & verdict(m)))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for `score_documents` of a documents table."""
    stop = ", ".join("'" + w + "'" for w in _STOP_SET)
    count = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]+', '', 'g')))"
    tests = " AND ".join([f"{r.measure} >= {r.low}" for r in rules if r.low is not None] + [f"{r.measure} <= {r.high}" for r in rules if r.high is not None])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {count(_SYMBOLS)}::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  {count(_MARKS)} AS marks, {count(_UPPER)} AS upper, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS stops, len(l) AS lines FROM d LEFT JOIN r USING (doc_id)),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  word_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_ratio, marks::DOUBLE / greatest(n_words, 1) AS mark_ratio, stops::DOUBLE / greatest(n_words, 1) AS stop_ratio,
  n_dup_lines::DOUBLE / greatest(lines, 1) AS dup_line_ratio, upper::DOUBLE / greatest(word_chars, 1) AS upper_ratio FROM c)
SELECT *, NOT base_failed AND {tests} AS kept FROM m"""
