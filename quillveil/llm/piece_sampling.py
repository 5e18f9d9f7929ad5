"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has a node at each character boundary and an edge for
each piece that matches there; a character that is no piece has an edge of its
bytes. A piece of rank r weighs (r + 1) ** -alpha, for the ranks in the model's
order. Forward filtering sums the weights of all paths to each node; backward
sampling then draws, from the end, the edge into each node in proportion to
the sum before it times its own weight. That is an exact draw from all
segmentations.

No piece crosses the start of a run of blanks, a line feed, or a pair of
characters that no piece holds, so the lattice falls apart into segments there. In each block of text, each distinct segment
is filtered once, all of them together, depth by depth; then all segments are
sampled together, piece by piece. The random number at a node is a
hash of the seed, the row's key, and the node's place in the row, so a row
gets the same segmentation wherever, and however often, it is worked on.

U+2581 stands for a blank in pieces; where a text holds it itself, it is
encoded as bytes, so decoding gives every text back.

Defined results: a null or empty text has no pieces and decodes to the empty
text; rows that repeat an id share its randomness, so repeated rows are alike; a
row without id takes that of id 0; ids that are no whole numbers go by their
hash; long texts are worked on in blocks, a long segment in whole; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches, buffers, mix, power_tables, prefix_sums, span_hashes, span_keys, tidy
from quillveil.llm.tokenizing import PieceBpe, cached

SEED = 20240229
ALPHA = 0.5
_OUT_IDS = 1 << 20
_SHORT = 64
_SPREAD = 0x9FB21C651E98DF25 & (2**44 - 1) | 1


class Lattice:
    """The vocabulary as weights, and lattices of the distinct segments of a block.

    Nodes are byte positions, numbered by depth first, so those of one depth
    are neighbours; edges of a node lie together, longest first. A lattice
    lives as long as its block, so memory does not grow with the vocabulary of
    the corpus.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        self.pieces = cached(PieceBpe, path)
        sp = self.pieces.sp
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.weight = {sp.id_to_piece(i): ((r + 1.0) ** -alpha, i) for r, i in enumerate(normal)}
        self.rare = (len(normal) + 1.0) ** -alpha
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        text = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(PieceBpe.BLANK, " ").encode() for i in range(size)]
        self.piece_size = np.array([len(x) for x in text], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        keys = span_keys(self.piece_bytes, self.piece_at[normal], self.piece_at[normal] + self.piece_size[normal])
        self.sizes = sorted({int(n) for n in self.piece_size[normal]}, reverse=True)
        self.mask = (1 << (4 * len(normal) - 1).bit_length()) - 1
        self.slots, self.slot_ids = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        for k, i in zip(keys.tolist(), normal, strict=True):
            at = (k * _SPREAD >> 20) & self.mask
            while self.slot_ids[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at], self.slot_ids[at] = k, i
        self.by_id = np.zeros(size)
        self.by_id[normal] = [(r + 1.0) ** -alpha for r in range(len(normal))]

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, -1 if it is none."""
        at = ((keys * np.uint64(_SPREAD)) >> np.uint64(20)).astype(np.int64) & self.mask
        out = self.slot_ids[at]
        rest = np.flatnonzero((out >= 0) & (self.slots[at] != keys))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            got = self.slot_ids[at[rest]]
            out[rest] = got
            rest = rest[(got >= 0) & (self.slots[at[rest]] != keys[rest])]
        return out

    def filter(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of segments: last node of each; of nodes, first edge and edge count; of edges, start node, width, piece, cumulative probability."""
        size = ends - starts
        long = np.flatnonzero(size > _SHORT)
        short = np.flatnonzero(size <= _SHORT)
        short = short[np.argsort(-size[short], kind="stable")]
        s, n = starts[short], size[short]
        deepest = int(n[0]) if len(n) else 0
        # Nodes of depth d are those of the segments that reach it, which come first.
        reach = np.searchsorted(-n, -np.arange(deepest + 1), "right")
        base = np.concatenate(([0], np.cumsum(reach)))
        nodes = int(base[-1])
        depth = np.repeat(np.arange(deepest + 1), reach)
        rank = np.arange(nodes) - base[depth]
        place = s[rank] + depth
        sums = prefix_sums(data)
        down = power_tables(len(data) + 1)[1]
        found = []
        single = np.zeros(nodes, bool)
        lead = np.append((data & 0xC0) != 0x80, True)
        for width in self.sizes:
            if width > deepest:
                continue
            at = np.arange(int(base[width]), nodes)
            end = place[at]
            begin = end - width
            piece = self._lookup((sums[end] - sums[begin]) * down[begin])
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], width, piece[hit]))
            if width <= 4:
                single[at[hit]] |= _one_character(lead, begin[hit], width)
        for width in range(min(4, deepest), 0, -1):
            at = np.arange(int(base[width]), nodes)
            at = at[~single[at]]
            begin = place[at] - width
            raw = at[lead[place[at]] & lead[begin] & _one_character(lead, begin, width)]
            found.append((raw, width, np.full(len(raw), -1, np.int32)))
        found.sort(key=lambda x: -x[1])
        count = np.zeros(nodes, np.int32)
        for at, _, _ in found:
            count[at] += 1
        first = np.cumsum(count, dtype=np.int64) - count
        total = int(count.sum())
        back, width_, piece_, node_ = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int64)
        filled = first.copy()
        for at, width, piece in found:
            slot = filled[at]
            filled[at] += 1
            back[slot] = base[depth[at] - width] + rank[at]
            width_[slot], piece_[slot], node_[slot] = width, piece, at
        weight = np.where(piece_ >= 0, self.by_id[piece_], self.rare**width_)
        forward = np.zeros(nodes)
        forward[: int(base[1]) if deepest or nodes else 0] = 1.0
        for d in range(1, deepest + 1):
            lo, hi = int(base[d]), int(base[d + 1])
            x, y = int(first[lo]), int(first[hi]) if hi < nodes else total
            forward[lo:hi] = np.bincount(node_[x:y] - lo, forward[back[x:y]] * weight[x:y], hi - lo)
        share = forward[back] * weight / forward[node_] if total else np.zeros(0)
        run = np.cumsum(share)
        full = np.flatnonzero(count)
        run = run - np.repeat(run[first[full]] - share[first[full]], count[full])
        run[first[full] + count[full] - 1] = 2.0
        last = np.zeros(len(starts), np.int64)
        last[short] = base[n] + np.arange(len(short))
        parts = [(first, count, back, width_, piece_, run)]
        edges = total
        for i in long.tolist():
            made = self._filter_long(data, sums, down, lead, int(starts[i]), int(size[i]))
            made[0][:] += edges
            made[2][:] += nodes
            nodes, edges = nodes + len(made[0]), edges + len(made[2])
            last[i] = nodes - 1
            parts.append(made)
        return last, *[np.concatenate(x) for x in zip(*parts, strict=True)]

    def _filter_long(self, data: np.ndarray, sums: np.ndarray, down: np.ndarray, lead: np.ndarray, s: int, n: int) -> tuple[np.ndarray, ...]:
        """The same for one long segment, whose nodes are its bytes: edges are found all at once, sums run from node to node.

        Sums are kept as a number and a power of two, so they neither vanish nor overflow.
        """
        found, single = [], np.zeros(n + 1, bool)
        for width in self.sizes:
            if width > n:
                continue
            end = np.arange(s + width, s + n + 1)
            piece = self._lookup((sums[end] - sums[end - width]) * down[end - width])
            hit = np.flatnonzero(piece >= 0)
            found.append((hit + width, width, piece[hit]))
            if width <= 4:
                single[hit + width] |= _one_character(lead, s + hit, width)
        for width in range(min(4, n), 0, -1):
            at = width + np.flatnonzero(~single[width:])
            raw = at[lead[s + at] & _one_character(lead, s + at - width, width)]
            found.append((raw, width, np.full(len(raw), -1, np.int32)))
        node = np.concatenate([x[0] for x in found])
        width_ = np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in found])
        piece_ = np.concatenate([x[2] for x in found]).astype(np.int32)
        order = np.lexsort((-width_, node))
        node, width_, piece_ = node[order], width_[order], piece_[order]
        count = np.bincount(node, minlength=n + 1).astype(np.int32)
        first = np.cumsum(count, dtype=np.int64) - count
        back = node - width_
        weight = np.where(piece_ >= 0, self.by_id[piece_], self.rare**width_)
        f, e = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        forward, power = memoryview(f), memoryview(e)
        forward[0], now, j, total = 1.0, 0, 0, 0.0
        for at, to, w in zip(memoryview(node), memoryview(back), memoryview(weight), strict=True):
            if at != j:
                if total and not 1e-100 < total < 1e100:
                    now += math.frexp(total)[1]
                j, total = at, 0.0
            # A node's sum is forward * 2 ** power; powers of nodes in reach differ by little.
            total += w * (forward[to] if power[to] == now else math.ldexp(forward[to], power[to] - now))
            forward[at], power[at] = total, now
        share = np.ldexp(f[back] * weight, e[back] - e[node]) / f[node]
        run = np.cumsum(share)
        full = np.flatnonzero(count)
        run = run - np.repeat(run[first[full]] - share[first[full]], count[full])
        run[first[full] + count[full] - 1] = 2.0
        return first, count, back, width_, piece_, run

    def sample(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Backward sampling of all segments of a block: ids at the bytes where pieces begin, -1 elsewhere.

        key: of the row, place: in the row of the segment's end; both per segment.
        """
        out = np.full(len(data), -1, np.int32)
        if not len(starts):
            return out
        _, pick, entry = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        last, first, count, back, width_, piece_, run = self.filter(data, starts[pick], ends[pick])
        node, pos, place = last[entry], ends.copy(), place.astype(np.uint64)
        long = ends - starts > _SHORT
        for i in np.flatnonzero(long).tolist():
            self._sample_long(data, out, int(starts[i]), int(ends[i]), int(node[i]), key[i], place[i], first, width_, piece_, run)
        node, pos, place, key = node[~long], pos[~long], place[~long], key[~long]
        while len(node):
            u = (mix(key ^ mix(place)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            on = np.flatnonzero(run[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[run[edge[on]] <= u[on]]
            width, piece = width_[edge], piece_[edge]
            pos = pos - width
            place = place - width.astype(np.uint64)
            out[pos] = piece
            raw = np.flatnonzero(piece < 0)
            for k in range(4 if len(raw) else 0):
                part = raw[width[raw] > k]
                out[pos[part] + k] = self.byte_ids[data[pos[part] + k]]
            node = back[edge]
            live = np.flatnonzero(count[node])
            if len(live) < len(node):
                node, pos, place, key = node[live], pos[live], place[live], key[live]
        return out

    def _sample_long(self, data: np.ndarray, out: np.ndarray, s: int, end: int, node: int, key, place, first, width_, piece_, run) -> None:
        """The same for one long segment, step by step."""
        n = end - s
        places = place - np.uint64(n) + np.arange(1, n + 1, dtype=np.uint64)
        u = memoryview((mix(key ^ mix(places)) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        first, width, piece, run, ids = (memoryview(x) for x in (first[node - n : node + 1], width_, piece_, run, out))
        at = n
        while at:
            x, edge = u[at - 1], first[at]
            while run[edge] <= x:
                edge += 1
            at -= width[edge]
            if piece[edge] >= 0:
                ids[s + at] = piece[edge]
            else:
                for k in range(s + at, s + at + width[edge]):
                    ids[k] = int(self.byte_ids[data[k]])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, with the dummy blank."""
        size = self.piece_size[ids]
        shift = self.piece_at[ids] - (np.cumsum(size) - size)
        return self.piece_bytes[np.repeat(shift, size) + np.arange(int(size.sum()))]


def _one_character(lead: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Whether the bytes from `begin` are one character."""
    out = lead[begin].copy()
    for k in range(1, width):
        out &= ~lead[begin + k]
    return out


class _Maker:
    def __init__(self, alpha: float):
        self.alpha = alpha

    def __call__(self, path: str) -> Lattice:
        return Lattice(path, self.alpha)

    def __hash__(self) -> int:
        return hash(("lattice", self.alpha))

    def __eq__(self, other) -> bool:
        return isinstance(other, _Maker) and other.alpha == self.alpha


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """Randomness of each row, from a whole number."""
    n = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix(mix(n + np.uint64(0x2545F4914F6CDD1D)) ^ np.uint64(seed & (2**64 - 1)))


def sampled_documents(lattice: Lattice, keys: np.ndarray, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Row, sampled ids, and whether they decode to the row's text; row after row."""
    held, base, fine = [], 0, True
    for lo, hi, part, s, e, first, more in _blocks(lattice.pieces, data, off):
        count = np.diff(first)
        row = np.repeat(np.arange(lo, hi), count)
        begin = s[np.minimum(first[:-1], max(0, len(s) - 1))] if len(s) else np.zeros(hi - lo, np.int64)
        got = lattice.sample(part, s, e, keys[row], e - begin[row - lo] + base)
        placed = np.flatnonzero(got >= 0)
        ids = got[placed]
        cut = np.searchsorted(placed, np.append(s, len(part))[first])
        same = np.array_equal(lattice.decode_bytes(ids), part)
        if more or held or base:
            held.append(ids)
            base, fine = base + len(part), fine and same
            if not more:
                yield lo, np.concatenate(held), fine
                held, base, fine = [], 0, True
            continue
        for i in range(hi - lo):
            own = ids[cut[i] : cut[i + 1]]
            yield lo + i, own, same or np.array_equal(lattice.decode_bytes(own), part[s[first[i]] if count[i] else 0 : e[first[i + 1] - 1] if count[i] else 0])


def _blocks(pieces: PieceBpe, data: np.ndarray, off: np.ndarray):
    """Row range, bytes, segment starts, ends, first segment of each row, and whether the last row goes on."""
    data, off = pieces.prepare(data, off)
    for lo, hi, part, o, more in pieces.parts(data, off):
        s, e, first = pieces.segments(part, o)
        yield lo, hi, part, s, e, first, more


def sample_pieces(docs: DataFrame, model_path: str, seed: int = SEED, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, ids (sampled), ids_crc32 (of little-endian unsigned 32-bit ids), lossless."""
    maker = _Maker(alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = cached(maker, model_path)

        def out(b: pa.RecordBatch, size: np.ndarray, rows: list[int], held: list[np.ndarray], fine: list[bool]) -> pa.RecordBatch:
            off = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(held).astype(np.int32)))
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in held]
            return pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows)), pa.array(size[rows]), pa.array(np.diff(off).astype(np.int64)), ids, pa.array(crc, pa.int64()), pa.array(fine)], names=[id_col, "n_bytes", "n_tokens", "ids", "ids_crc32", "lossless"])

        for b in batches:
            data, off = buffers(b.column(1))
            size, rows, held, fine, n = np.diff(off), [], [], [], 0
            for i, ids, ok in sampled_documents(lattice, row_keys(b.column(2), seed), data, off):
                rows.append(i)
                held.append(ids)
                fine.append(bool(ok))
                n += len(ids)
                if n >= _OUT_IDS:
                    yield out(b, size, rows, held, fine)
                    rows, held, fine, n = [], [], [], 0
            if rows:
                yield out(b, size, rows, held, fine)

    bounded_batches(docs.sparkSession)
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(0).cast("long"))
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), key.alias("_key"))
    return source.mapInArrow(tidy(run, True), f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, lossless boolean")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = cached(_Maker(ALPHA), model_path)
        for b in batches:
            texts = []
            for x in b.column(1):
                ids = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)
                texts.append(lattice.decode_bytes(ids)[1:].tobytes().decode() if len(ids) else "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")
