"""Sinks: only documents that passed are written, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.functions.reports import header_value
from quillveil.operators.verdict import passed_only


def write_passed(pages: DataFrame, verdict: DataFrame, path: str, mode: str = "errorifexists") -> None:
    passed_only(pages, verdict).write.mode(mode).parquet(path)


def report_rows(verdict: DataFrame) -> DataFrame:
    """(doc_id, report, truncated) with the report in its header form."""
    body = F.to_json(F.struct(*[F.col(c) for c in verdict.columns]))
    return verdict.select("doc_id", header_value(body).alias("_h")).select("doc_id", "_h.report", "_h.truncated")
