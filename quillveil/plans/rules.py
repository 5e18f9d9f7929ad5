"""Rules and requests: strict parsing, and compilation of rules to patterns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Literal

import regex

from quillveil.functions import detectors as D
from quillveil.functions.folding import MARKS, fold_pattern, fold_with_map, has_welded_letters, literal_pattern

MOST_RECTS = 500


class RequestError(ValueError):
    """A request that cannot be served; `code` names why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Rule:
    """One rule, compiled. `native`: its pattern is ours and may run in the JVM."""

    rule_id: str
    kind: Literal["search", "regex", "preset"]
    pattern: str
    native: bool
    ignore_case: bool = True
    ignore_accents: bool = False
    multiline: bool = False
    pages: tuple[int, ...] | None = None
    literal: str | None = None

    @property
    def java_pattern(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


def page_scope(pages: list[int] | None) -> tuple[int, ...] | None:
    """None and [] are all pages; repeats go, order stays; a negative page is an error."""
    if not pages:
        return None
    if any(p < 0 for p in pages):
        raise RequestError("invalid_scope", "page numbers begin at 0")
    return tuple(dict.fromkeys(pages))


def search_rule(query: str, rule_id: str = "search", case_sensitive: bool = False, whole_word: bool = True, ignore_accents: bool = True, pages: list[int] | None = None) -> Rule:
    """Exact text. White space between its words is flexible; welded letters match their glyph.

    Whole words are not preceded or followed by a word character. Where accents
    do not count, letters match with any combining marks after them, so composed
    and decomposed text are found alike. A query that needs neither words,
    accents nor glyphs keeps its literal, so a scan can look for that first.
    """
    query = query.strip()
    if not query:
        raise RequestError("invalid_query", "the query is empty")
    text = fold_with_map(query)[0] if ignore_accents else query
    body = r"\s+".join(literal_pattern(t, MARKS if ignore_accents else "") for t in text.split())
    if whole_word:
        body = rf"(?<!\w){body}(?!\w)"
    plain = not ignore_accents and not has_welded_letters(text) and len(text.split()) == 1
    return Rule(rule_id, "search", body, True, not case_sensitive, ignore_accents, True, page_scope(pages), text if plain else None)


def regex_rules(patterns: str | list[str], rule_id: str = "regex", case_sensitive: bool = False, multiline: bool = False, ignore_accents: bool = True, pages: list[int] | None = None, whole_word: bool = False) -> list[Rule]:
    """User patterns: stripped, empty ones dropped, checked here; they run in Python under a time budget."""
    given = [patterns] if isinstance(patterns, str) else patterns
    kept = [p.strip() for p in given if p.strip()]
    if not kept:
        raise RequestError("invalid_pattern", "no pattern is given")
    out = []
    for i, p in enumerate(kept):
        body = fold_pattern(p) if ignore_accents else p
        if whole_word:
            body = ("" if body.startswith((r"(?<!\w)", r"\b")) else r"(?<!\w)") + f"(?:{body})" + ("" if body.endswith((r"(?!\w)", r"\b")) else r"(?!\w)")
        try:
            regex.compile(body, regex.V0)
        except regex.error as e:
            raise RequestError("invalid_pattern", f"{p!r}: {e}") from e
        out.append(Rule(f"{rule_id}:{i}", "regex", body, False, not case_sensitive, ignore_accents, multiline, page_scope(pages)))
    return out


def preset_rules(keys: list[str], pages: list[int] | None = None) -> list[Rule]:
    """Detectors by key: always case-insensitive, never folded."""
    if not keys:
        raise RequestError("invalid_presets", "no detector is named")
    found = []
    for k in dict.fromkeys(keys):
        try:
            d = D.detector(k)
        except ValueError as e:
            raise RequestError("invalid_presets", str(e)) from e
        found.append(Rule(f"preset:{k}", "preset", d.pattern, True, True, False, d.multiline, page_scope(pages)))
    return found


@dataclass(frozen=True)
class Options:
    """What is done with what the rules do not reach; the defaults redact."""

    image_mode: str = "pixels"
    apply_graphics: bool = True
    sanitize_metadata: bool = True
    remove_annotations: bool = True
    remove_attachments: bool = True
    remove_outline: bool = True
    remove_document_actions: bool = True
    image_regions: str = "review"
    ocr_proposals: bool = False
    ocr_language: str | None = None

    def __post_init__(self):
        if self.image_mode not in ("none", "remove", "pixels"):
            raise RequestError("schema", f"image_mode {self.image_mode!r}")
        if self.image_regions not in ("ignore", "review", "block"):
            raise RequestError("schema", f"image_regions {self.image_regions!r}")

    def switches_off(self) -> frozenset[str]:
        names = ("sanitize_metadata", "remove_annotations", "remove_attachments", "remove_outline", "remove_document_actions")
        return frozenset(n for n in names if not getattr(self, n))


@dataclass(frozen=True)
class Request:
    """A parsed request; rules in the order search, regex, presets."""

    rects: list[tuple[int, float, float, float, float]] = field(default_factory=list)
    full_pages: list[int] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    bans: list[Rule] = field(default_factory=list)
    options: Options = field(default_factory=Options)
    acknowledged_regions: list[tuple[int, float, float, float, float]] = field(default_factory=list)
    acknowledged_font_pages: list[int] = field(default_factory=list)
    password: str | None = None

    @property
    def textual(self) -> bool:
        return bool(self.rules)


# The keys of a request and of its parts.
_TOP = {"rects", "full_page_rects", "search", "regex", "searches", "regexes", "presets", "options", "audit", "acknowledged_regions", "acknowledged_font_pages", "password"}
_PARTS = {
    "search": {"query", "options", "scope"},
    "search.options": {"case_sensitive", "whole_word", "ignore_accents"},
    "regex": {"patterns", "case_sensitive", "multiline", "ignore_accents", "scope"},
    "presets": {"keys", "scope"},
    "scope": {"pages"},
    "audit": {"patterns", "regex", "case_sensitive"},
    "rect": {"page", "x0", "y0", "x1", "y1"},
    "region": {"page", "bbox"},
}


def _strict(value: dict, allowed: set[str], where: str) -> dict:
    if not isinstance(value, dict):
        raise RequestError("schema", f"{where} is not an object")
    if unknown := set(value) - allowed:
        raise RequestError("schema", f"unknown keys in {where}: {', '.join(sorted(unknown))}")
    return value


def _pages(part: dict) -> list[int] | None:
    scope = part.get("scope")
    return _strict(scope, _PARTS["scope"], "scope").get("pages") if scope is not None else None


def _rect(value: dict) -> tuple[int, float, float, float, float]:
    r = _strict(value, _PARTS["rect"], "rect")
    if r["page"] < 0:
        raise RequestError("schema", "page numbers begin at 0")
    return (r["page"], *(float(r[k]) for k in ("x0", "y0", "x1", "y1")))


def parse_request(payload: str | dict) -> Request:
    """A request from JSON; unknown keys and wrong values raise RequestError."""
    try:
        top = _strict(json.loads(payload) if isinstance(payload, str) else payload, _TOP, "the request")
    except json.JSONDecodeError as e:
        raise RequestError("schema", str(e)) from e
    if len(top.get("rects", [])) + len(top.get("full_page_rects", [])) > MOST_RECTS:
        raise RequestError("too_many_rects", f"more than {MOST_RECTS} rectangles")
    rules: list[Rule] = []
    searches = [*top.get("searches", []), *([top["search"]] if top.get("search") else [])]
    for i, s in enumerate(searches):
        part = _strict(s, _PARTS["search"], "search")
        options = _strict(part.get("options", {}), _PARTS["search.options"], "search options")
        rules.append(search_rule(part["query"], f"search:{i}", pages=_pages(part), **options))
    patterns = [*top.get("regexes", []), *([top["regex"]] if top.get("regex") else [])]
    for i, p in enumerate(patterns):
        part = dict(_strict(p, _PARTS["regex"], "regex"))
        pages = _pages(part)
        part.pop("scope", None)
        rules += regex_rules(part.pop("patterns"), f"regex:{i}", pages=pages, **part)
    if top.get("presets"):
        part = _strict(top["presets"], _PARTS["presets"], "presets")
        rules += preset_rules(part.get("keys", []), _pages(part))
    names = {f.name for f in fields(Options)}
    options = Options(**_strict(top.get("options", {}), names, "options"))
    bans: list[Rule] = []
    if top.get("audit"):
        part = _strict(top["audit"], _PARTS["audit"], "audit")
        case = part.get("case_sensitive", True)
        for i, p in enumerate(part.get("patterns", [])):
            if part.get("regex"):
                bans += regex_rules(p, f"ban:{i}", case_sensitive=case, ignore_accents=False)
            elif p.strip():
                bans.append(search_rule(p, f"ban:{i}", case_sensitive=case, whole_word=False, ignore_accents=False))
    regions = []
    for r in top.get("acknowledged_regions", []):
        part = _strict(r, _PARTS["region"], "region")
        regions.append((part["page"], *map(float, part["bbox"])))
    return Request([_rect(r) for r in top.get("rects", [])], [_rect(r | dict.fromkeys(("x0", "y0", "x1", "y1"), 0.0) if "x0" not in r else r)[0] for r in top.get("full_page_rects", [])], rules, bans, options, regions, list(top.get("acknowledged_font_pages", [])), top.get("password"))


def resolve_language(requested: str | None, available: list[str]) -> str | None:
    """Recognition language: what is asked for, else fra+eng, else eng, else the first; only available parts."""
    for wish in (requested, "fra+eng", "eng"):
        if wish and (parts := [p for p in wish.split("+") if p in available]):
            return "+".join(parts)
    return available[0] if available else None
