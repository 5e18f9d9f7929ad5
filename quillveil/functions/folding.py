"""Accent folding and literal patterns; the only place that knows about Unicode decomposition."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter groups that fonts weld into one glyph, and the glyph.
LIGATURES = {"ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "ft": "ﬅ", "st": "ﬆ", "ae": "æ", "oe": "œ"}
_UPPER_GLYPHS = {"æ": "Æ", "œ": "Œ"}


#: Combining marks, which a decomposed accent puts after its letter.
MARKS = r"\p{M}*"


def fold_char(c: str) -> str:
    """The base letter of an accented or styled character; itself where there is none or more than one."""
    bases = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    return bases[0] if len(bases) == 1 else c


def fold(text: str) -> str:
    """Fold every character; the length stays."""
    return "".join(map(fold_char, text))


@functools.cache
def fold_pairs() -> tuple[str, str]:
    """All characters that fold to another one, and those others, from the Unicode data."""
    pairs = [(c, f) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (f := fold_char(c)) != c]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


def fold_column(text: Column) -> Column:
    """`fold` inside the JVM, as one `translate`."""
    source, target = fold_pairs()
    return F.translate(text, source, target)


def fold_with_map(text: str) -> tuple[str, list[int]]:
    """Folded text in which combining marks join the character before them, and the bounds of its characters in the original."""
    out, bounds = [], []
    for i, c in enumerate(text):
        if unicodedata.combining(c) and out:
            continue
        out.append(fold_char(c))
        bounds.append(i)
    return "".join(out), [*bounds, len(text)]


def fold_with_map_column(text: Column) -> Column:
    """`fold_with_map` for text that may be decomposed: struct of folded text and bounds."""

    @F.pandas_udf("struct<folded string, bounds array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [fold_with_map(t or "") for t in texts]
        return pd.DataFrame({"folded": [m[0] for m in made], "bounds": [m[1] for m in made]})

    return run(text)


def fold_pattern(pattern: str, drop_marks: bool = True) -> str:
    """A regular expression with its literals folded and its escapes as they are."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if not (drop_marks and unicodedata.combining(pattern[i])):
            out.append(fold_char(pattern[i]))
        i += 1
    return "".join(out)


def quote(c: str) -> str:
    """One character as a literal for Java, Python and RE2 expressions."""
    return "\\" + c if c in "\\.^$|?*+()[]{}-/&#~" else c


def literal_pattern(text: str, marks: str = "") -> str:
    """A pattern for a literal in which welded letters and their glyph match each other, in either spelling.

    marks: a pattern for what may follow each character, such as combining marks.
    """
    glyphs = {g: letters for letters, g in LIGATURES.items()} | {_UPPER_GLYPHS[g]: x for x, g in LIGATURES.items() if g in _UPPER_GLYPHS}
    longest_first = sorted(LIGATURES, key=len, reverse=True)
    out, i = [], 0
    while i < len(text):
        found = next((x for x in longest_first if text[i : i + len(x)].lower() == x), None)
        if text[i] in glyphs:
            out.append(f"(?:{text[i]}|{marks.join(glyphs[text[i]])}){marks}")
            i += 1
        elif found:
            glyph = LIGATURES[found]
            glyph = _UPPER_GLYPHS.get(glyph, glyph) if text[i].isupper() else glyph
            out.append(f"(?:{marks.join(map(quote, text[i : i + len(found)]))}|{glyph}){marks}")
            i += len(found)
        else:
            out.append(quote(text[i]) + marks)
            i += 1
    return "".join(out)


def has_welded_letters(text: str) -> bool:
    """Whether `literal_pattern` differs from plain quoting."""
    return literal_pattern(text) != "".join(map(quote, text))
