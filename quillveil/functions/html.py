"""Hidden carriers of an HTML page: each is cut whole, never searched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Carrier groups with the switch that turns each off (None: always cut) and what it cuts.
CARRIERS = {
    "metadata": ("sanitize_metadata", [r"(?is)<title\b[^>]*>.*?</title\s*>", r"(?is)<meta\b[^>]*>"]),
    "annotations": ("remove_annotations", [r"(?is)\shref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", r"(?is)</?(?:input|button|select|textarea|form)\b[^>]*>", r"(?is)\sid\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"]),
    "attachments": ("remove_attachments", [r"(?is)<object\b[^>]*>.*?</object\s*>", r"(?is)<embed\b[^>]*>", r"(?is)\bdata:[a-z]+/[a-z0-9.+-]+[^\"'\s>]*"]),
    "outline": ("remove_outline", [r"(?is)<nav\b[^>]*>.*?</nav\s*>"]),
    "actions": ("remove_document_actions", [r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"]),
    "hidden": (None, [r"(?s)<!--.*?-->", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)\s(?:alt|aria-[a-z]+)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"]),
}


def patterns(off: frozenset[str] = frozenset()) -> list[str]:
    """Patterns to cut, in order, without the groups whose switches are off."""
    unknown = off - {switch for switch, _ in CARRIERS.values() if switch}
    if unknown:
        raise ValueError(f"unknown switches: {', '.join(sorted(unknown))}")
    return [p for switch, ps in CARRIERS.values() if switch not in off or switch is None for p in ps]


def sanitized(html: Column, off: frozenset[str] = frozenset()) -> Column:
    """The page without its carriers."""
    for p in patterns(off):
        html = F.regexp_replace(html, p, "")
    return html


def visible_text(html: Column) -> Column:
    """Text of a page without carriers and tags, white space collapsed."""
    bare = F.regexp_replace(sanitized(html), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
