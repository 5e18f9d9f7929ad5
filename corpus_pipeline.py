"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` writes the
result of each as Parquet in the shared folder and reads it as the next one's
docs, so no stage is worked out twice and a lost executor costs one stage at
most, and deletes what the stage wrote on its way. All but the last give the
columns of documents.

Defined results, for every stage: columns beside the id and the text pass
through, whatever their names (the last returns pieces); an empty table gives an
empty one; texts of any length are worked on in whole. A null or empty text goes
in the first stage; given to a later one it is kept as it is, and packed as the
end id alone. Rows that repeat an id are judged each by the first stage; the
second keeps one row of each id and component; the third takes rows that repeat
id and text for one document and cuts them alike; the fourth packs every row.
Rows without id are kept by every stage that keeps their text, and come first
where order decides. Of near duplicates the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.ngram_join import drop_near_duplicates
from quillveil.llm.packing import pack_documents
from quillveil.llm.quality import apply_rules
from quillveil.llm.queries import tokenizer_path
from quillveil.llm.suffix_dedup import remove_repeats
from quillveil.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier; n_chars follows the text."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", packed)]

#: Near-duplicate groups, suffixes and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
