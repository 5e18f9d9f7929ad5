"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.quality import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.suffix_dedup import repeated_spans

    return repeated_spans(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.warc import warc_round_trip

    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.embedding_dedup import link_vectors

    return link_vectors(_read(spark, sf_dir, "embeddings"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.piece_sampling import sample_pieces

    return sample_pieces(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.token_files import token_files

    return token_files(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.ngram_join import link_documents

    return link_documents(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillveil.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_license_scan": op1_license_scan, "op2_quality_rules": op2_quality_rules, "op3_suffix_dedup": op3_suffix_dedup, "op4_warc": op4_warc, "op5_token_counts": op5_token_counts, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_packing": op7_packing, "op8_embedding_dedup": op8_embedding_dedup, "op9_piece_sampling": op9_piece_sampling, "op10_token_files": op10_token_files}


def oracle_sql() -> dict[str, str]:
    from quillveil.llm import embedding_dedup, ngram_join, quality, warc

    return {"op2_quality_rules": quality.oracle_sql(), "op4_warc": warc.ORACLE_SQL, "op6_ngram_jaccard": ngram_join.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL}
