"""Matches of rules in pages of text, as rows with their spans.

Pages are (doc_id, page, text). Rules of our own run inside the JVM; user
patterns run in Arrow batches on Python's `regex`, since nothing in the JVM stops
a pattern that backtracks. Their budget is time spent matching, by each task: it
neither runs while nothing is matched nor depends on when the query was built.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions.detectors import detector
from quillveil.functions.folding import fold_column
from quillveil.functions.text import match_spans
from quillveil.plans.rules import Rule

BUDGET_SECONDS = 10.0
HIT = "rule_id string, kind string, start int, end int, match string"


class PatternTimeout(ValueError):
    """A user pattern used up the budget of the request."""


def _view(text: Column, rule: Rule) -> Column:
    return fold_column(text) if rule.ignore_accents else text


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a native rule; folding keeps lengths, so they hold for the text itself."""
    view = _view(text, rule)
    spans = match_spans(view, rule.java_pattern)
    if rule.kind == "preset" and (accept := detector(rule.rule_id.removeprefix("preset:")).accept):
        spans = F.filter(spans, lambda s: accept(s["match"]))
    if rule.literal is not None:
        # Texts without the literal need no regular expression.
        needle, hay = (rule.literal.lower(), F.lower(view)) if rule.ignore_case else (rule.literal, view)
        spans = F.when(F.contains(hay, F.lit(needle)), spans).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    return spans


def in_scope(page: Column, rule: Rule) -> Column:
    return F.lit(True) if rule.pages is None else page.isin(list(rule.pages))


def page_spans(text: Column, page: Column, rules: list[Rule]) -> Column:
    """Array of (rule_id, kind, start, end, match) of native rules on one page, within the row."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def tagged(r: Rule) -> Column:
        spans = F.when(in_scope(page, r), rule_spans(text, r)).otherwise(none)
        # Only a folded view differs from the text.
        original = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) if r.ignore_accents else s["match"]
        return F.transform(spans, lambda s: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), original(s).alias("match")))

    return F.concat(*[tagged(r) for r in rules])


def _native_hits(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One scan of the pages for all native rules."""
    spans = page_spans(F.col("text"), F.col("page"), rules)
    return pages.select("doc_id", "page", F.explode(spans).alias("hit")).select("doc_id", "page", "hit.*")


def _line_pairs(view: str) -> Iterator[tuple[int, int, int, str]]:
    """Each line that is not blank with the next such line: starts of both, length of the first, and the two joined by a blank."""
    at, last = 0, None
    for line in view.split("\n"):
        if line.strip():
            if last is not None:
                yield last[0], at, len(last[1]), f"{last[1]} {line}"
            last = (at, line)
        at += len(line) + 1


def _regex_hits(pages: DataFrame, rules: list[Rule], budget: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        from quillveil.functions.folding import fold_with_map

        compiled = [(r, regex.compile(r.pattern, regex.V0 | regex.UNICODE | (regex.IGNORECASE if r.ignore_case else 0))) for r in rules]
        left = budget

        def matches(r: Rule, p, view: str) -> list[tuple[int, int]]:
            nonlocal left
            began = time.perf_counter()
            try:
                if left <= 0:
                    raise TimeoutError
                return [m.span() for m in p.finditer(view, timeout=left)]
            except TimeoutError as e:
                raise PatternTimeout(f"pattern {r.pattern!r} used up the budget of {budget} s") from e
            finally:
                left -= time.perf_counter() - began

        def found_in(r: Rule, p, view: str) -> list[tuple[int, int]]:
            spans = matches(r, p, view)
            if r.multiline and "\n" in view:
                # A match that goes on in the next line, whatever parts the two.
                seen = set(spans)
                for first, second, cut, pair in _line_pairs(view):
                    seen |= {(first + s, second + e - cut - 1) for s, e in matches(r, p, pair) if s < cut and e > cut + 1}
                spans = sorted(seen)
            return spans

        for b in batches:
            rows = []
            for doc, page, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                text = text or ""
                folded = fold_with_map(text) if any(r.ignore_accents for r in rules) else None
                for r, p in compiled:
                    if r.pages is not None and page not in r.pages:
                        continue
                    view, bounds = folded if r.ignore_accents else (text, None)
                    for s, e in found_in(r, p, view):
                        if bounds is not None:
                            s, e = bounds[s], bounds[e]
                        rows.append((doc, page, r.rule_id, r.kind, s, e, text[s:e]))
            types = [b.column(0).type, b.column(1).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "page", "rule_id", "kind", "start", "end", "match"])

    kinds = dict(pages.dtypes)
    return pages.select("doc_id", "page", "text").mapInArrow(scan, f"doc_id {kinds['doc_id']}, page {kinds['page']}, {HIT}")


def find_hits(pages: DataFrame, rules: list[Rule], budget: float = BUDGET_SECONDS) -> DataFrame:
    """(doc_id, page, rule_id, kind, start, end, match) of every match, empty ones included.

    budget: seconds that the user patterns of each task may take.
    """
    native, user = [r for r in rules if r.native], [r for r in rules if not r.native]
    parts = ([_native_hits(pages, native)] if native else []) + ([_regex_hits(pages, user, budget)] if user else [])
    if not parts:
        raise ValueError("no rule is given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def next_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Each line with the next one of its page, for text without geometry."""
    w = Window.partitionBy("doc_id", "page").orderBy(*order)
    return lines.withColumns({"next_no": F.lead("line_no").over(w), "next_text": F.lead("text").over(w)}).filter(F.col("next_no").isNotNull())


def pair_hits(pairs: DataFrame, rules: Rule | list[Rule], budget: float = BUDGET_SECONDS) -> DataFrame:
    """Matches across the boundary of two lines, joined by a line feed or by a blank; a match found both ways counts once.

    A match that has only the joiner on one side has an empty span there.
    """
    cut = F.length("text").alias("cut")
    joined = pairs.select(F.struct("doc_id", "line_no", "next_no", cut).alias("doc_id"), "page", "text", "next_text", F.explode(F.array(F.lit("\n"), F.lit(" "))).alias("joiner"))
    found = find_hits(joined.select("doc_id", "page", F.concat("text", "joiner", "next_text").alias("text")), rules if isinstance(rules, list) else [rules], budget)
    hits = found.select("doc_id.*", "page", "rule_id", "kind", "start", "end").filter((F.col("start") <= F.col("cut")) & (F.col("end") > F.col("cut")))
    left = F.struct(F.col("start"), F.col("cut").alias("end"))
    right = F.struct(F.lit(0).alias("start"), (F.col("end") - F.col("cut") - 1).alias("end"))
    return hits.select("doc_id", "page", "rule_id", "kind", "line_no", "next_no", left.alias("left_span"), right.alias("right_span")).distinct()


#: Bound of a request's literals, which every task holds.
MOST_LITERAL_BYTES = 64 << 20


def collected_literals(literals: DataFrame) -> dict[int, list[str]]:
    """(literal_id, text) rows of a request, by id; an error if they exceed their bound."""
    size = literals.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_LITERAL_BYTES:
        raise ValueError(f"the literals have {size} bytes; every task holds them, so at most {MOST_LITERAL_BYTES} are taken")
    out: dict[int, list[str]] = {}
    for r in literals.select("literal_id", "text").distinct().collect():
        out.setdefault(r.literal_id, []).append(r.text)
    return out


def documents_with_literals(pages: DataFrame, literals: DataFrame) -> DataFrame:
    """(doc_id, page, literal_id) where a page holds one of the literals (literal_id, text): one automaton finds all of a request's literals in one pass."""
    by_id = collected_literals(literals)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for key, texts in by_id.items():
            for text in filter(None, texts):
                by_text.setdefault(text, []).append(key)
        for text, keys in by_text.items():
            automaton.add_word(text, keys)
        if by_text:
            automaton.make_automaton()
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(2).to_pylist()):
                if text and by_text:
                    found = {k for _, keys in automaton.iter(text) for k in keys}
                    rows += [(i, k) for k in sorted(found)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "page", "literal_id"])

    kinds = dict(pages.dtypes)
    return pages.select("doc_id", "page", "text").mapInArrow(scan, f"doc_id {kinds['doc_id']}, page {kinds['page']}, literal_id bigint")
