"""Tokenizers over Arrow batches, with each distinct word encoded once per worker.

Both encoders cut texts only where the library's own result is provably the
concatenation of the parts' results, and take the ids of every distinct part
from the library itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quillveil.llm.bytesops import BLOCK, WordTable, ascii_words, row_blocks, safe_cuts, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_cached: dict[tuple, object] = {}


def cached(kind, path: str):
    """One encoder of its kind and file for each worker process."""
    key = (kind, path)
    if key not in _cached:
        _cached[key] = kind(path)
    return _cached[key]


def text_parts(data: np.ndarray, off: np.ndarray, is_cut) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Blocks: first row, end row, bytes, offsets, whether a long row goes on in the next block."""
    for lo, hi in row_blocks(off):
        a, b = int(off[lo]), int(off[hi])
        if b - a <= 2 * BLOCK or hi - lo > 1:
            yield lo, hi, data[a:b], off[lo : hi + 1] - a, False
            continue
        cuts = safe_cuts(data[a:b], BLOCK, is_cut)
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            yield lo, hi, data[a + x : a + y], np.array([0, y - x]), i < len(cuts) - 2


#: ASCII classes: letters, digits, apostrophe, bar, other marks; 0 is white space and all that is not ASCII.
_CLASS = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _CLASS[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 3 if _c == 39 else 4 if _c == 124 else 5
#: Pairs of neighbouring classes that no token spans. An apostrophe may begin a contraction, a bar a special string.
_CUT = np.zeros((8, 8), bool)
for _a, _b in ((1, 2), (1, 3), (1, 5), (2, 1), (2, 2), (2, 3), (2, 5), (3, 2), (5, 1), (5, 2)):
    _CUT[_a, _b] = True


class WordBpe:
    """`tokenizers` file that splits texts at white space and between letters, digits and marks, in lower case.

    The normaliser (NFC, white space to one blank, lower case) and the split
    pattern treat ASCII white space, and most changes between ASCII letters,
    digits and marks, as boundaries that no token spans, so the ids of a text
    are those of its parts in turn. Parts keep apostrophes before letters,
    bars, and all that is not ASCII with their neighbours, so contractions,
    special strings and composed characters get the library's own treatment.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.table = WordTable(self._encode)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with ASCII letters in lower case where that changes no token, starts and ends of parts, and the first part of each row."""
        s, e, first = ascii_words(data, off)
        if not len(s):
            return data, s, e, first
        kind = _CLASS[data]
        cut = np.flatnonzero(_CUT[kind[:-1], kind[1:]]) + 1
        # Texts lie side by side: a cut at the start of a row is there already.
        cut = cut[~np.isin(cut, off, kind="sort")] if len(cut) else cut
        starts, ends = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
        if not np.any((data[:-1] == 60) & (data[1:] == 124)):  # the bytes that special strings begin with
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= data[1:] < 128
            data = np.where(upper, data + 32, data).astype(np.uint8)
        return data, starts, ends, np.searchsorted(starts, off)

    def blocks(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """Row range, ids of its texts in a row, number of ids per row, and whether its last row goes on."""
        for lo, hi, part, o, more in text_parts(data, off, lambda x: _SPACE[x]):
            part, s, e, first = self.parts(part, o)
            ids, lens = self.table.gather(self.table.entries(part, s, e, span_hashes(part, s, e)))
            ends = np.concatenate(([0], np.cumsum(lens)))
            yield lo, hi, ids, np.diff(ends[first]), more

    def documents(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Row and its ids, row after row."""
        held: list[np.ndarray] = []
        for lo, hi, ids, counts, more in self.blocks(data, off):
            if more:
                held.append(ids)
                continue
            if held:
                yield lo, np.concatenate([*held, ids])
                held = []
                continue
            at = np.concatenate(([0], np.cumsum(counts))).tolist()
            for i in range(hi - lo):
                yield lo + i, ids[at[i] : at[i + 1]]


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs of characters in a bit set of 2**22."""
    return (((a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters of UTF-8 bytes."""
    if not (data & 0x80).any():
        return np.arange(len(data)), data.astype(np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at]
    more = (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    code = first & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint8)[more]
    code = code.astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(more >= k)
        code[long] = (code[long] << np.uint32(6)) | (data[np.minimum(at[long] + k, len(data) - 1)] & 0x3F)
    return at, code


class PieceBpe:
    """SentencePiece BPE model with byte fallback and no normalisation.

    A blank becomes U+2581, with one more put before the text. No piece holds
    U+2581 after another character, and none holds a line feed, so merges never
    cross the start of a run of blanks or the two sides of a line feed; nor do
    they cross two neighbouring characters that no piece holds side by side. So
    the ids of a text are those of the segments between these places, and
    segments are short in any script. The first two facts are checked when the
    model is loaded; the pairs are looked up in a bit set, where a clash only
    leaves a segment whole.
    """

    BLANK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(self.BLANK in p.lstrip(self.BLANK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross blanks or lines")
        self.head = sp.encode("\nx")[:-1]
        self.table = WordTable(self._encode)
        pairs = np.array(sorted({(32 if a == self.BLANK else ord(a), 32 if b == self.BLANK else ord(b)) for p in pieces for a, b in zip(p, p[1:])}), np.uint32).reshape(-1, 2)
        self.together = np.zeros(1 << 22, bool)
        self.together[_pair_slots(pairs[:, 0], pairs[:, 1])] = True

    def _encode(self, segments: list[str]) -> list[list[int]]:
        # A line feed in front stands in for the dummy blank, which is dropped with it.
        skip = len(self.head)
        return [ids[skip:] for ids in self.sp.encode(["\n" + x for x in segments], num_threads=1)]

    @staticmethod
    def prepare(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with the dummy blank before each one that is not empty."""
        full = np.flatnonzero(np.diff(off) > 0)
        out = np.insert(data, off[full], 32)
        return out, off + np.concatenate(([0], np.cumsum(np.diff(off) > 0)))

    @staticmethod
    def _blanks(data: np.ndarray) -> np.ndarray:
        """Which bytes are blanks, or of the character that stands for them."""
        blank = data == 32
        if len(data) > 2 and (mark := np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))).size:
            for k in range(3):
                blank[mark + k] = True
        return blank

    def _opens(self, data: np.ndarray) -> np.ndarray:
        """Where segments begin, from the bytes alone."""
        blank = self._blanks(data)
        line = data == 10
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens |= line
        opens[1:] |= line[:-1]
        at, code = _characters(data)
        if len(at) > 1:
            code[code == ord(self.BLANK)] = 32
            opens[at[1:][~self.together[_pair_slots(code[:-1], code[1:])]]] = True
        return opens

    def parts(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """`text_parts`, with long texts cut where segments begin; only a single longer segment makes a longer part."""

        def is_cut(x: np.ndarray) -> np.ndarray:
            lead = np.flatnonzero((x[:4] & 0xC0) != 0x80)
            skip = int(lead[0]) if len(lead) else 0  # the rest of a character
            opens = np.zeros(len(x), bool)
            opens[skip:] = self._opens(x[skip:])
            opens[: skip + 3] = False  # the character before may lie outside
            return opens

        return text_parts(data, off, is_cut)

    def segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of segments, and the first segment of each row (with one past the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        opens = self._opens(data)
        opens[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, off)

    def blocks(self, data: np.ndarray, off: np.ndarray, table: WordTable | None = None) -> Iterator[tuple]:
        """Row range, block bytes, segment starts, ends, first segment of each row, entries of the table, whether the last row goes on."""
        table = table or self.table
        data, off = self.prepare(data, off)
        for lo, hi, part, o, more in self.parts(data, off):
            s, e, first = self.segments(part, o)
            yield lo, hi, part, s, e, first, table.entries(part, s, e, span_hashes(part, s, e)), more
