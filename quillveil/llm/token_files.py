"""Token ids in ORC files.

Documents are range-partitioned by id and, for rows that share an id, by a hash of
their text, and sorted, so file k comes before file k+1 and one id may hold any
share of the rows. Each row has an array of ids; ORC stores it by integer
run-length encoding, with row indexes in every stripe and a Bloom filter on the
document id, so a reader takes stripes in parallel and skips those whose
metadata rule an id out (`read_ids`).

Defined results: a null text counts as empty and yields the end id alone; equal
document ids keep a row each, in order of the hash of their text (`part`), rows
that repeat both are alike; null ids come first; texts of any length are encoded
in whole, in blocks; an empty table writes no row; further columns of the input
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches, buffers, tidy
from quillveil.llm.tokenizing import WordBpe, cached
from quillveil.session import partitions_for, scratch_path

END_ID = 2
_OUT_IDS = 1 << 20
_FILES_IN_BLOCK = 1000


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, ids array<int>), in the order of the input's partitions; part: hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached(WordBpe, tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def out(b: pa.RecordBatch, rows: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            off = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(held).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*[b.column(i).slice(rows[0], len(rows)) for i in (0, 2)], ids], names=[id_col, "part", "ids"])

        for b in batches:
            rows, held, size = [], [], 0
            for i, ids in words.documents(*buffers(b.column(1))):
                rows.append(i)
                held.append(np.concatenate((ids, tail)))
                size += len(ids)
                if size >= _OUT_IDS:
                    yield out(b, rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield out(b, rows, held)

    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("part"))
    return source.mapInArrow(tidy(run, True), f"{id_col} {dict(docs.dtypes)[id_col]}, part bigint, ids array<int>")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of all documents in ascending order of their document ids.

    The texts, not the ids, are dealt out by range: the sampling pass behind
    the range bounds then costs a scan and no tokenization.
    """
    files = files or partitions_for(docs)
    part = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    ordered = docs.select(F.col(id_col), F.col(text_col).alias("_text"), part.alias("_part")).repartitionByRange(files, id_col, "_part").sortWithinPartitions(id_col, "_part")
    encode_documents(ordered, tokenizer_path, end_id, id_col, "_text").write.options(
        **{"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    ).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of all documents, or of a few through stripe statistics and Bloom filters."""
    df = spark.read.orc(path).select(id_col, "ids")
    return df if doc_ids is None else df.filter(F.col(id_col).isin(doc_ids))


def summarize_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: start (ids before it in the whole set), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            off = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(memoryview(flat[x:y]).cast("B")) if y > x else 0 for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "_part", "_file", "n_tokens", "ids_crc32"])

    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    scan = spark.read.orc(path).select(F.col(id_col), F.col("part"), F.col("ids"), number.alias("_file"))
    rows = scan.mapInArrow(run, f"{id_col} {dict(scan.dtypes)[id_col]}, _part bigint, _file int, n_tokens bigint, ids_crc32 bigint")
    sizes = scan.groupBy("_file").agg(F.sum(F.size("ids").cast("long")).alias("_ids")).withColumn("_block", F.expr(f"_file DIV {_FILES_IN_BLOCK}"))
    # Ids before each file: sums over the files of its block, and over blocks, of which there is one for a thousand files.
    before = lambda w: F.coalesce(F.sum("_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("_block").agg(F.sum("_ids").alias("_ids")).select("_block", before(Window.orderBy("_block")).alias("_base"))
    base = sizes.select("_file", "_block", before(Window.partitionBy("_block").orderBy("_file")).alias("_own")).join(blocks, "_block").select("_file", (F.col("_base") + F.col("_own")).alias("_base"))
    inside = Window.partitionBy("_file").orderBy(id_col, "_part", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "_file").select(id_col, (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files into the shared folder, read them back, and describe each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "orc-ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return summarize_ids(spark, path)
