"""Registry of the redaction engine's queries and of their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillveil.catalog import auditing, files, layouts, texts
from quillveil.catalog.common import Entry


def _entries() -> dict[str, Entry]:
    return texts.ENTRIES | layouts.ENTRIES | auditing.ENTRIES | files.ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in _entries().items() if e.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.verdict_per_document(spark, sf_dir)
