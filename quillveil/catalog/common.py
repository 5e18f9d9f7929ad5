"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillveil.functions import detectors as D
from quillveil.session import spread
from quillveil.sources.readers import document_pages, read_table


@dataclass(frozen=True)
class Entry:
    """A query, and DuckDB SQL for its rows where SQL can express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of texts are spread over the cores if they are small."""
    df = read_table(spark, sf_dir, name)
    key = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}.get(name)
    return spread(df, key) if key else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text)."""
    return document_pages(table(spark, sf_dir, "documents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages."""
    return document_pages(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn")


EMAIL_SQL = "(?i)" + D.EMAIL
CARD_SQL = D.CARD
PHONE_SQL = "(?i)" + D.PHONE
#: What is no part of a word, for RE2.
BREAK_SQL = r"[^\pL\pM\pN\p{Pc}]"


def spans_sql(source: str, pattern: str, keys: str = "doc_id", text: str = "text") -> str:
    """SQL for (keys, start_at, end_at, match) of all matches, by running sums of the lengths of gaps and matches."""
    return f"""
SELECT {keys}, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start_at,
 (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INTEGER AS end_at, m[i] AS "match", {text}
FROM (SELECT {keys}, {text}, m, regexp_split_to_array({text}, '{pattern}') AS g, unnest(range(1, len(m) + 1)) AS i
 FROM (SELECT {keys}, {text}, regexp_extract_all({text}, '{pattern}') AS m FROM {source}))"""
