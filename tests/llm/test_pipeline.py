"""The pipeline against the brute-force versions, stage by stage."""

import pytest

import corpus_pipeline
from tests.llm import reference as R


@pytest.fixture(scope="module")
def staged(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "packing"]
    docs, good, single, cut, packed = staged
    for df in (good, single, cut):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    source = texts(docs)
    assert texts(good).items() <= source.items()
    assert not any(R.quality(t)[5] for t in texts(good).values())
    assert texts(single) == {i: t for i, t in texts(good).items() if R.jaccard(list(texts(good).items()))[i][2]}
    removed = R.suffixes(list(texts(single).items()))
    got = texts(cut)
    for i, t in texts(single).items():
        assert (got[i] == t) == (removed[i][1] == 0)
        assert 0 <= len(t.encode()) - len(got[i].encode()) - removed[i][1] <= 3 * 2 * max(1, removed[i][2])
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(got)
    assert {r.doc_id: r.n_chars for r in cut.collect()} == {i: len(t) for i, t in got.items()}


def test_run(spark, small, staged):
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(corpus_pipeline.run(spark, small)) == key(staged[-1])


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
