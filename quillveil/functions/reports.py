"""Reports as compact JSON in a header-safe form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 6000


def header_value(report_json: Column, most: int = MOST_CHARS) -> Column:
    """URL-safe base64 of a report, and whether it is too long to send."""
    encoded = F.translate(F.base64(F.encode(report_json, "UTF-8")), "+/", "-_")
    encoded = F.regexp_replace(encoded, "[\r\n]", "")
    long = F.length(encoded) > most
    return F.struct(F.when(~long, encoded).alias("report"), long.alias("truncated"))


def digest_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))
