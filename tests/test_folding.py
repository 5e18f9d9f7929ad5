import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.functions.folding import fold, fold_column, fold_pattern, fold_with_map, has_welded_letters, literal_pattern


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_length_and_idempotence(text):
    assert len(fold(text)) == len(text)
    assert fold(fold(text)) == fold(text)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_map_bounds(text):
    folded, bounds = fold_with_map(text)
    assert len(bounds) == len(folded) + 1
    assert bounds[-1] == len(text)


def test_column_agrees(spark):
    texts = ["éàü ß ﬁ œ", "é", "𝐁𝐨𝐥𝐝", "Ｆｕｌｌ", "plain", "", "İ", "ÅÇÑ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.orderBy("i").select(fold_column(F.col("t")).alias("f")).collect()] == [fold(t) for t in texts]


def test_decomposed_joins():
    assert fold_with_map(unicodedata.normalize("NFD", "né"))[0] == "ne"


def test_patterns():
    assert fold_pattern(r"\bréé\w") == r"\bree\w"
    assert literal_pattern("office") == "o(?:ffi|ﬃ)ce"
    assert has_welded_letters("fi") and not has_welded_letters("abc")
    assert literal_pattern("ﬁ") == "(?:ﬁ|fi)"
