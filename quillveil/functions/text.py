"""Text expressions: spans of matches, snippets, white space, text rebuilding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 30
CHUNK = 256
SPAN = "array<struct<start:int,end:int,match:string>>"


def collapse_space(text: Column) -> Column:
    """White-space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches with their places in code points, end exclusive.

    The gaps between matches come from `split`, so places are running sums of
    lengths; `regexp_instr` would count UTF-16 units. Sums run in chunks, so a
    text with very many matches does not copy its list for each. The pattern
    must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda x: x["match"].isNotNull())
    size = lambda x: F.length(x["gap"]) + F.length(x["match"])

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = acc["at"] + size(x)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["match"].alias("match")))).alias("out"))

    def run(part: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def chunked(b: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(b) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(b, c * CHUNK + 1, F.lit(CHUNK))
        sums = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda n, x: n + size(x)))
        return let(sums, lambda t: F.flatten(F.transform(chunks, lambda c: run(part(c), F.aggregate(F.slice(t, F.lit(1), c), F.lit(0), lambda n, x: n + x)))))

    return let(both, lambda b: F.when(F.size(b) <= CHUNK, run(b, F.lit(0))).otherwise(chunked(b)))


def snippet(text: Column, start: Column, end: Column, around: int = SNIPPET_CHARS) -> Column:
    """The text around a span, line feeds shown as an escape."""
    first = F.greatest(start - around, F.lit(0))
    return F.replace(F.substring(text, first + 1, end + around - first), F.lit("\n"), F.lit("\\n"))


def spans_line_break(match: Column) -> Column:
    return F.contains(match, F.lit("\n"))


def shorten(text: Column, most: int = 56) -> Column:
    """Trimmed, and cut with an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def merge_spans(spans: Column) -> Column:
    """Sorted maximal spans; overlapping and touching ones become one.

    How far the spans up to each one reach comes from widening: after round k a
    place holds the farthest end of the 4**k spans up to it. So the work is that
    of the spans times the logarithm of their number.
    """
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def reached(ends: Column, k: int) -> Column:
        if k == 12:
            return ends
        step = 4**k
        before = lambda e, x, i: [F.coalesce(F.get(e, i - j * step), x) for j in (1, 2, 3)]
        return let(ends, lambda e: F.when(F.size(e) > step, reached(F.transform(e, lambda x, i: F.greatest(x, *before(e, x, i))), k + 1)).otherwise(e))

    def islands(s: Column) -> Column:
        def cut(far: Column) -> Column:
            opens = F.filter(F.transform(s, lambda x, i: F.when(x["start"] > F.coalesce(F.get(far, i - 1), F.lit(-1)), i)), lambda i: i.isNotNull())
            return let(opens, lambda o: F.transform(o, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.get(far, F.coalesce(F.get(o, j + 1), F.size(s)) - 1).alias("end"))))

        return let(reached(F.transform(s, lambda x: x["end"]), 0), cut)

    return let(plain, islands)


_PIECE = 4096


def cut_spans(text: Column, spans: Column, mark: str = "") -> Column:
    """The text with merged, sorted spans replaced by `mark`.

    A place in a string is found by counting from its start, so the text is cut
    into short pieces first, and each kept part is taken from the few it lies in.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def kept(p: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _PIECE).cast("int")
        few = F.slice(p, first + 1, F.floor((b - 1) / _PIECE).cast("int") - first + 1)
        return F.when(b <= a, F.lit("")).otherwise(F.substring(F.array_join(few, ""), F.pmod(a, F.lit(_PIECE)) + 1, b - a))

    def rebuilt(p: Column) -> Column:
        gaps = F.transform(spans, lambda x, i: kept(p, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), x["start"]))
        tail = kept(p, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)), F.length(text))
        return F.array_join(F.concat(gaps, F.array(tail)), mark)

    return let(pieces, rebuilt)
