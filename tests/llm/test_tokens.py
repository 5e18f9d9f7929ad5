"""Token counts, files, packing and sampling against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm.packing import TIERS, Packer, pack_documents
from quillveil.llm.piece_sampling import decode_pieces, sample_pieces
from quillveil.llm.token_counts import PrefixCounter, ask_tables, count_at, count_tokens, longest_within, prefix_tables
from quillveil.llm.token_files import read_ids, token_files, write_ids


@pytest.fixture(scope="session")
def pieces(tokenizer):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def word_ids(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts(docs, rows, odd, none, tokenizer, pieces):
    path = tokenizer("piece_bpe_32k.model")
    for df, want in ((docs, rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        made = count_tokens(df, path).collect()
        texts = dict(want)
        for r in made:
            raw = (texts[r.doc_id] or "").encode()
            assert len(pieces.encode(raw[: r.limit_bytes].decode())) <= 4096 and (r.limit_bytes == len(raw)) == (not r.over_limit)
            half = len(raw[: len(raw) // 2].decode("utf-8", "ignore"))
            half += len((texts[r.doc_id] or "")[:half].encode()) < len(raw) // 2  # the character that the middle cuts counts
            assert r.half_tokens == len(pieces.encode((texts[r.doc_id] or "")[:half]))
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in made}
        assert got == {i: (len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for i, t in want}
    assert count_tokens(none, path).count() == 0


def test_long_text_in_blocks(spark, tokenizer, pieces):
    text = ("some words and more\n" * 9 + "y" * 70 + " ") * 18_000
    df = spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in count_tokens(df, tokenizer("piece_bpe_32k.model")).collect()}
    assert r[2].n_tokens == len(pieces.encode(text)) and r[2].over_limit and r[3].n_tokens == len(pieces.encode("c"))


def test_long_line_in_blocks(tokenizer, pieces):
    from quillveil.llm.tokenizing import PieceBpe

    bpe = PieceBpe(tokenizer("piece_bpe_32k.model"))
    text = "".join(f"w{i:x}{'  ' if i % 3 else ' '}" + ("\u2581 z " if i % 5 == 0 else "é") for i in range(450_000))
    data = np.frombuffer(text.encode(), np.uint8)
    sizes, ids = [], []
    for _, _, part, _, _, _, at, _ in bpe.blocks(data, np.array([0, len(data)])):
        sizes.append(len(part))
        ids.append(bpe.table.gather(at)[0])
    assert len(data) > 4 << 20 and max(sizes) < (1 << 20) + 100
    assert np.concatenate(ids).tolist() == pieces.encode(text)


def test_blocks_of_more_words_than_the_table_holds():
    from quillveil.llm.bytesops import WordTable, span_hashes

    table = WordTable(lambda words: [[int(w)] for w in words], capacity=600)
    for n in (3000, 10, 5000):
        data = np.frombuffer(b"".join(b"%05d" % i for i in range(n)), np.uint8)
        starts = np.arange(n) * 5
        ids, _ = table.gather(table.entries(data, starts, starts + 5, span_hashes(data, starts, starts + 5)))
        assert ids.tolist() == list(range(n))


TEXT = st.one_of(st.text(max_size=40), st.text(alphabet="ab e\u2581\n中国的é😀1,", max_size=60))


@settings(max_examples=120, deadline=None)
@given(TEXT)
def test_every_prefix(text):
    """The stored table has the library's count at every prefix, and no encoder is asked when it answers."""
    import public_tokenizers

    counter = test_every_prefix.__dict__.setdefault("counter", PrefixCounter(str(public_tokenizers.path("piece_bpe_32k.model"))))
    table = counter.stored(text)
    want = [len(counter.sp.encode(text[:i])) for i in range(len(text) + 1)]
    size = [len(text[:i].encode()) for i in range(len(text) + 1)]
    sp, counter.sp, counter.pieces.sp = counter.sp, None, None  # any call of the encoder would fail
    try:
        assert [count_at(table, n) for n in size] == want
        for budget in range(0, max(want) + 2):
            assert longest_within(table, budget) == max(n for n, c in zip(size, want) if c <= budget)
    finally:
        counter.sp = counter.pieces.sp = sp


def test_prefixes_of_documents(rows, tokenizer, pieces):
    import random

    counter, rng = PrefixCounter(tokenizer("piece_bpe_32k.model")), random.Random(4)
    for _, text in rng.sample([r for r in rows if r[1]], 25):
        table = counter.stored(text)
        for i in [rng.randrange(len(text) + 1) for _ in range(8)]:
            assert count_at(table, len(text[:i].encode())) == len(pieces.encode(text[:i]))


def test_scripts_without_blanks(tokenizer, pieces):
    """Segments are short in any script; long runs of letters are worked on as they are."""
    import random
    import time

    rng, counter = random.Random(5), PrefixCounter(tokenizer("piece_bpe_32k.model"))
    han = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(330_000))
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    for text in (han, code, "x" * 5000, "ab" * 3000):
        began = time.process_time()
        table = counter.stored(text)
        assert time.process_time() - began < 0.9 * max(1.0, len(text.encode()) / 1e6)
        assert count_at(table, len(text.encode())) == len(pieces.encode(text))


def test_tables_are_stored(spark, odd, tokenizer, tmp_path):
    prefix_tables(odd, tokenizer("piece_bpe_32k.model")).write.parquet(f"{tmp_path}/t")
    tables = spark.read.parquet(f"{tmp_path}/t")
    got = sorted(map(tuple, ask_tables(tables, 3).collect()))
    assert got == sorted(map(tuple, count_tokens(odd, tokenizer("piece_bpe_32k.model"), 3).collect()))


def test_words_with_one_hash():
    """Words whose hashes clash keep entries of their own."""
    from quillveil.llm.bytesops import WordTable

    words = [b"a", b"b", b"a", b"a word of more than sixteen bytes", b"a word of more than 16 bytes, too", b"a word of more-than sixteen bytes", b"b"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    table = WordTable(lambda found: [list(w.encode()) for w in found])
    for _ in range(2):
        at = table.entries(data, starts, ends, np.zeros(len(words), np.uint64))
        ids, lens = table.gather(at)
        assert bytes(ids.astype(np.uint8)) == b"".join(words) and lens.tolist() == [len(w) for w in words]


def check_files(df, word_ids, tokenizer):
    source = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files(df, tokenizer("word_bpe_49k.json")).collect()}
    at = 0
    for i, t in source:
        ids = word_ids(t)
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)


def test_files(docs, odd, none, word_ids, tokenizer):
    check_files(docs, word_ids, tokenizer)
    check_files(odd, word_ids, tokenizer)
    assert token_files(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_files_of_repeated_ids(spark, word_ids, tokenizer):
    """Rows that share an id, or have none, keep a row each; starts follow the order of the files, whatever share one id has."""
    texts = [f"text number {i} " * (i % 7) for i in range(60)]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)] + [(5, texts[1])] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted(token_files(df, tokenizer("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(word_ids(t)), crc(word_ids(t))) for i, t in rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()


def test_long_texts(spark, word_ids, tokenizer, pieces):
    """Texts of several blocks, with and without blanks, in files and in windows."""
    rows = [(1, "word " * 600_000), (2, "a,b;" * 5000), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_files(df, word_ids, tokenizer)
    check_packing(df, word_ids, tokenizer)


def test_packing_of_repeated_ids(spark, word_ids, tokenizer):
    """Rows that repeat an id or have none are packed each, every id of theirs once, and ties come out alike."""
    rows = [(i % 3 or None, f"some words {i % 5} " * (i % 40)) for i in range(90)] + [(1, "same")] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    key = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    made = sorted(pack_documents(df, tokenizer("word_bpe_49k.json")).collect(), key=key)
    assert sum(r.length for r in made) == sum(len(word_ids(t)) for _, t in rows)
    assert sum(1 for r in made if r.start == 0) == len(rows)
    assert list(map(key, made)) == sorted(map(key, pack_documents(df, tokenizer("word_bpe_49k.json")).collect()))


def test_file_reads_one_document(spark, docs, rows, word_ids, tokenizer, tmp_path):
    write_ids(docs, f"{tmp_path}/ids", tokenizer("word_bpe_49k.json"), files=3)
    i, t = rows[17]
    assert [list(r.ids) for r in read_ids(spark, f"{tmp_path}/ids", [i]).collect()] == [word_ids(t)]


def check_packing(df, word_ids, tokenizer):
    source = {r.doc_id: r.text for r in df.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack_documents(df, tokenizer("word_bpe_49k.json")).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(source)
    for i, t in source.items():
        ids, at = word_ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= TIERS[-1] and at & (at - 1) == 0
        sizes.append(at)
    return sizes


def test_packing(docs, odd, none, word_ids, tokenizer):
    sizes = check_packing(docs, word_ids, tokenizer)
    assert sum(s < TIERS[0] for s in sizes) <= 12
    check_packing(odd, word_ids, tokenizer)
    assert pack_documents(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_many_tasks(docs, word_ids, tokenizer):
    check_packing(docs.repartition(70, "doc_id"), word_ids, tokenizer)


def test_packer_balances_steps():
    p = Packer(0, step_tokens=8192)
    for i in range(40):
        p.add(i, 0, np.full(3000, i, "<u4"), 3000)
    p.finish()
    p.finish_at_powers()
    steps = defaultdict(set)
    for r in p.rows:
        steps[r[8]].add((r[5], r[7]))
    assert all(len({w for _, w in s}) == 1 and sum(w for _, w in s) <= 8192 for s in steps.values())


def check_sampling(df, pieces, tokenizer):
    path = tokenizer("piece_bpe_32k.model")
    source = {r.doc_id: r.text or "" for r in df.collect()}
    made = sample_pieces(df, path)
    got = {r.doc_id: r for r in made.collect()}
    assert all(r.lossless and r.ids_crc32 == crc(r.ids) and r.n_tokens == len(r.ids) for r in got.values())
    assert {r.doc_id: r.text for r in decode_pieces(made, path).collect()} == source
    return got


def test_sampling(docs, odd, none, pieces, tokenizer):
    a = check_sampling(docs, pieces, tokenizer)
    b = {r.doc_id: r.ids for r in sample_pieces(docs.repartition(5, "doc_id"), tokenizer("piece_bpe_32k.model")).collect()}
    assert {i: r.ids for i, r in a.items()} == b
    other = {r.doc_id: r.ids for r in sample_pieces(docs, tokenizer("piece_bpe_32k.model"), seed=1).collect()}
    assert other != b
    for i, t in [(r.doc_id, r.text) for r in docs.limit(20).collect()]:
        assert pieces.decode(list(a[i].ids)) == t
    check_sampling(odd, pieces, tokenizer)
    assert sample_pieces(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_sampling_cases(spark, tokenizer):
    """Repeated ids share their randomness, null takes that of 0, ids may be texts, long texts and segments come back."""
    path = tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(0, "the same words"), (None, "the same words"), (7, "the same words"), (7, "the same words"), (8, "words of a page " * 150_000), (9, "ab" * 3000)], "doc_id bigint, text string")
    got = sample_pieces(df, path).collect()
    assert all(r.lossless for r in got) and got[0].ids == got[1].ids and got[2].ids == got[3].ids and got[0].ids != got[2].ids
    named = sample_pieces(df.selectExpr("cast(doc_id AS string) AS doc_id", "text").filter("doc_id is null or doc_id < '8'"), path)
    assert named.filter("lossless").count() == 4


def test_long_segments_are_drawn_like_short_ones(tokenizer, monkeypatch):
    """The two ways of filtering give the same segmentations, and a long segment takes time in proportion."""
    import time

    import quillveil.llm.piece_sampling as P

    lattice = P.Lattice(tokenizer("piece_bpe_32k.model"))
    data = np.frombuffer("interesting abababab strasse été 😀x the    end internationalisation".encode(), np.uint8)
    off = np.array([0, len(data)])
    drawn = lambda: [P.sampled_documents(lattice, np.array([k], np.uint64), data, off).__next__()[1].tolist() for k in range(40)]
    want = drawn()
    monkeypatch.setattr(P, "_SHORT", 0)
    assert drawn() == want
    monkeypatch.undo()
    for text, most in (("ab" * 200_000, 9), ("".join(chr(0x4E00 + i * i % 9000) for i in range(300_000)), 3)):
        raw = np.frombuffer(text.encode(), np.uint8)
        began = time.process_time()
        assert next(P.sampled_documents(lattice, np.array([3], np.uint64), raw, np.array([0, len(raw)])))[2]
        assert time.process_time() - began < most * len(raw) / 1e6


def test_sampling_follows_the_lattice(spark, tokenizer):
    """Frequencies of segmentations of one word are those of all its paths."""
    from quillveil.llm.piece_sampling import ALPHA, Lattice

    lattice = Lattice(tokenizer("piece_bpe_32k.model"), ALPHA)
    word = "▁thin"

    def paths(at):
        if at == len(word):
            yield (), 1.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in lattice.weight:
                w, i = lattice.weight[word[at:end]]
                for rest, v in paths(end):
                    yield (i, *rest), w * v

    weights = dict(paths(0))
    total = sum(weights.values())
    df = spark.range(40_000).selectExpr("id AS doc_id", "'thin' AS text")
    seen = defaultdict(int)
    for r in sample_pieces(df, tokenizer("piece_bpe_32k.model")).select("ids").collect():
        seen[tuple(r.ids)] += 1
    assert set(seen) <= set(weights)
    for p, w in weights.items():
        share = w / total
        assert abs(seen[p] / 40_000 - share) < 5 * (share * (1 - share) / 40_000) ** 0.5 + 1e-4
