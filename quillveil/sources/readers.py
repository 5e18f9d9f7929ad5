"""Sources: tables of documents, files, and layout; rows that cannot be read are kept and say why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of layout tables.
SCHEMAS = {
    "words": "doc_id bigint, page int, block_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double",
    "glyphs": "doc_id bigint, page int, c string, x0 double, y0 double, x1 double, y1 double, dir_x double, dir_y double",
    "regions": "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, page_share double, text_ratio double, digest string, transform array<double>",
    "fonts": "doc_id bigint, page int, name string, subtype string, encoding string, has_tounicode boolean",
    "acks": "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double",
}
#: A file's signature and what it means here.
_PDF = "%PDF-"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_layout(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A layout table, with its schema stated and never inferred."""
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def document_pages(docs: DataFrame, page: str | None = None) -> DataFrame:
    """(doc_id, page, text): a document is one page, unless a column numbers its pages."""
    return docs.select("doc_id", (F.col(page) if page else F.lit(0)).cast("int").alias("page"), "text")


def _empty_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Files without a byte, from the listing: a scan skips them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path if glob is None else f"{path}/{glob}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(root) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if f.isFile() and f.getLen() == 0:
                found.append((f.getPath().toString(), f.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, _ms bigint")
    return rows.select("path", F.timestamp_millis("_ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Binary files with `read_error`: empty, not_a_pdf, encrypted (which needs a PDF library to open), or null."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).unionByName(_empty_files(spark, path, glob))
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    tail = F.decode(F.substring("content", -2048, 2048), "ISO-8859-1")
    error = F.when(F.length("content") == 0, "empty").when(head != _PDF, "not_a_pdf").when(F.contains(tail, F.lit("/Encrypt")), "encrypted")
    return files.withColumn("read_error", error)
