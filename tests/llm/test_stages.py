"""Cases of each pipeline stage: nulls, empty and long texts, repeats, empty tables, columns with clashing names."""

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
GOOD = " ".join(f"the word{i} and table{i} is here{i}" for i in range(30))
OTHER = " ".join(f"a river{i} was hill{i} to bed{i}" for i in range(30))
SCHEMA = "doc_id bigint, text string, lang string, n_chars int, n_words string, kept int, _sd_k string, start string, class string, c0 string"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(3, GOOD), (1, GOOD + " end"), (3, GOOD), (7, OTHER), (7, GOOD + " more"), (None, OTHER), (None, None), (8, None), (9, ""), (10, "short"), (11, " ".join(f"the long{i} text{i} of it{i}" for i in range(40_000)))]
    made = [(i, t, "en", len(t or ""), "w", 1, "k", "s", f"c{k}", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def left(df):
    return sorted(((r.doc_id, r["class"]) for r in df.collect()), key=str)


def test_quality(spark, table):
    out = STAGES["quality"](spark, table, "")
    assert out.schema == table.schema
    assert left(out) == sorted([(3, "c0"), (1, "c1"), (3, "c2"), (7, "c3"), (7, "c4"), (None, "c5"), (11, "c10")], key=str)


def test_near_duplicates(spark, table):
    out = STAGES["near_duplicates"](spark, table, "")
    assert out.schema == table.schema
    got = left(out)
    # Of the copies of GOOD the smallest id stays; 7 keeps its other text; rows without id stay.
    assert got == sorted([(1, "c1"), (7, "c3"), (None, "c5"), (None, "c6"), (8, "c7"), (9, "c8"), (10, "c9"), (11, "c10")], key=str)


def test_repeated_strings(spark, table):
    out = STAGES["repeated_strings"](spark, table, "")
    assert out.schema == table.schema and out.count() == table.count()
    got = {r["class"]: r for r in out.collect()}
    assert got["c5"].text == OTHER and got["c3"].text == "" and got["c3"].n_chars == 0  # the row without id comes first
    assert got["c1"].text == GOOD + " end" and got["c0"].text == got["c2"].text == "" and got["c4"].text.strip() == "more"
    assert got["c6"].text is None and got["c7"].text is None and got["c8"].text == "" and got["c9"].text == "short"
    assert all(r.lang == "en" and r._sd_k == "k" and r.c0 == "z" and r.kept == 1 for r in got.values())


def test_packing(spark, table):
    rows = STAGES["packing"](spark, table, "").collect()
    assert sum(1 for r in rows if r.start == 0) == table.count()
    assert {r.doc_id for r in rows} == {r.doc_id for r in table.collect()}


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, table, name):
    out = STAGES[name](spark, spark.createDataFrame([], SCHEMA), "")
    assert out.count() == 0 and (name == "packing" or out.schema == table.schema)


def test_one_row(spark, table):
    for name, stage in STAGES.items():
        assert stage(spark, table.filter("class = 'c0'"), "").count() >= 1, name
