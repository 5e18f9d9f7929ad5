"""Proposals from recognised text: the same rules on an ocr_words table, mapped back to the page.

They have a bucket of their own, are not audited, and never count as cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.functions.geometry import mapped_rect
from quillveil.operators.layout import lines_of, match_boxes
from quillveil.operators.matching import find_hits
from quillveil.plans.rules import Rule


def propose(ocr_words: DataFrame, transforms: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, page, x0..y1, rule_id, bucket) from words in image coordinates.

    transforms: doc_id, page, transform (image to page, six numbers)
    """
    lines = lines_of(ocr_words)
    hits = find_hits(lines.select(F.struct("doc_id", "page", "block_no", "line_no").alias("doc_id"), "page", "text"), rules).filter("end > start")
    hits = hits.select("doc_id.*", "rule_id", "start", "end").withColumn("hit_id", F.xxhash64("rule_id", "start", "end"))
    spans = lines.select("doc_id", "page", "block_no", "line_no", F.explode("spans").alias("s")).select("doc_id", "page", "block_no", "line_no", "s.*")
    words = spans.join(ocr_words.drop("text"), ["doc_id", "page", "block_no", "line_no", "word_no"]).withColumn("horizontal", F.lit(True))
    boxes = match_boxes(hits, words).join(hits.select("doc_id", "page", "block_no", "line_no", "hit_id", "rule_id"), ["doc_id", "page", "block_no", "line_no", "hit_id"])
    placed = boxes.join(transforms, ["doc_id", "page"])
    rect = mapped_rect(F.col("transform"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return placed.withColumns(rect).select("doc_id", "page", "x0", "y0", "x1", "y1", "rule_id", F.lit("ocr").alias("bucket"))
