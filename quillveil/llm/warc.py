"""WARC archives with resolved revisits.

Headers alone are shuffled, by payload digest, to find equal payloads and the
record that stays; the table of repeated digests is written out, so Spark knows
its size: it is broadcast below the session's threshold, and above that the
pages are joined to it by sort-merge, whose skewed digests adaptive execution
splits. Archives hold one response per payload and revisit records that refer
to it, all with fresh headers, and one `warcinfo` record in a file of its own.
They are written as gzip files whose row separator is WARC's own blank lines, and
read back by their Content-Length, a piece at a time. Files are bounded by bytes:
pages go by size into tiers, and a tier's largest page decides how many records
a file may take; a page beyond the last tier has a file of its own.

Defined results: a null payload counts as empty; of equal payloads the largest
page id is the response, and rows that repeat that id are responses too; a row
without page id is a revisit if any row with an id has its payload; line ends
in URLs are percent-encoded; long payloads are hashed and written in whole; an
empty table yields no page's record; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.bytesops import bounded_batches
from quillveil.session import materialize, scratch_path

MIN_BYTES = 0
FILE_BYTES = 128 << 20
#: Upper bounds of payload bytes by tier; the last tier has none.
TIERS = (64 << 10, 1 << 20, 16 << 20, None)
_HEADER_BYTES = 2 << 10
_PIECE = 1 << 20
_OUT_BYTES = 4 << 20
# Digits of base 32 as conv() writes them, and as RFC 4648 does.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: each 5 hexadecimal digits give 4 of base 32."""
    hexed = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _CONV_DIGITS, _BASE32_DIGITS)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def repeated_payloads(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, _original, _original_url): of each payload that occurs more than once, the page that stays."""
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    found = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(last.alias("_last"), F.count("*").alias("_n")).filter("_n > 1 AND _last IS NOT NULL")
    return found.select("payload_digest", F.col("_last.page_id").alias("_original"), F.col("_last.url").alias("_original_url"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of (page_id, url, html). date: WARC-Date of the records, now if not given."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("_payload"))
    whole = source.withColumns({"payload_digest": base32_sha1(F.col("_payload")), "payload_bytes": F.octet_length("_payload").cast("long")})
    repeats = materialize(repeated_payloads(whole.select("page_id", "url", "payload_digest", "payload_bytes"), min_bytes), "warc-repeats")
    info = f"software: quillveil\r\nformat: WARC File Format 1.1\r\ndescription: pages, equal payloads as revisits\r\nisPartOf: {path.rsplit('/', 1)[-1]}\r\n"
    about = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}"
    writer = lambda df, most: df.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    writer(pages.sparkSession.range(0, 1, 1, 1).select(F.lit(about).alias("value")), 1)
    largest = source.agg(F.max(F.octet_length("_payload"))).first()[0]
    low = 0
    for high in TIERS if largest is not None else ():
        if low <= largest:
            tier = whole.filter(F.col("payload_bytes") >= low if high is None else F.col("payload_bytes").between(low, high - 1))
            writer(_records(tier, repeats, min_bytes, date), 1 if high is None else max(1, file_bytes // (high + _HEADER_BYTES)))
        low = high


def _records(whole: DataFrame, repeats: DataFrame, min_bytes: int, date: str) -> DataFrame:
    """The records, as `value`."""
    joined = whole.join(repeats, "payload_digest", "left")
    revisit = F.col("_original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_original"))) & (F.col("payload_bytes") >= min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    identity = lambda page: _uuid(page.cast("string"), F.col("payload_digest"))
    joined = joined.withColumns({"_revisit": revisit, "_http": http}).withColumn("_block", F.when(F.col("_revisit"), F.col("_http")).otherwise(F.concat("_http", "_payload")))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    record = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", identity(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(
            F.col("_revisit"),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", identity(F.col("_original"))),
                line("WARC-Refers-To-Target-URI", F.col("_original_url")),
                line("WARC-Refers-To-Date", F.lit(date)),
                line("WARC-Refers-To-Page-ID", F.col("_original").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n\r\n"),
        F.col("_block"),
    )
    return joined.select(record.alias("value"))


def _unzipped(data: memoryview) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members."""
    at, unpack = 0, zlib.decompressobj(31)
    while at < len(data) or unpack.unconsumed_tail:
        raw = unpack.unconsumed_tail
        if not raw:
            raw, at = data[at : at + _PIECE], at + _PIECE
        yield unpack.decompress(raw, 8 * _PIECE)
        while unpack.eof and unpack.unused_data:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            yield unpack.decompress(rest, 8 * _PIECE)
        if unpack.eof:
            unpack = zlib.decompressobj(31)


def parse_archive(pieces: Iterator[bytes] | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, given whole or in pieces; no more than a record is held."""
    source, held, seen, more = iter([pieces] if isinstance(pieces, bytes) else pieces), bytearray(), 0, True

    def fill(size: int) -> bool:
        nonlocal more
        while more and len(held) < size:
            piece = next(source, None)
            more = piece is not None
            held.extend(piece or b"")
        return len(held) >= size

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {seen}")
        headers = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        start, stop = end + 4, end + 4 + int(headers["Content-Length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {seen} has a wrong Content-Length")
        yield headers, bytes(held[start:stop])
        del held[: stop + 4]
        seen += stop + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    A response's length and digest come from its payload and must agree with
    its headers; a revisit has those that its headers state.
    """

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 5 + payloads])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0):
                rows, held = [], 0
                for h, raw in parse_archive(_unzipped(memoryview(file.as_buffer()))):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    cut = raw.index(b"\r\n\r\n") + 4
                    body, digest = raw[cut:], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(raw[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    if h["WARC-Type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"{h['WARC-Record-ID']}: payload does not have the stated digest")
                    page, original = h.get("WARC-Page-ID"), h.get("WARC-Refers-To-Page-ID")
                    rows.append((page and int(page), size, digest, h["WARC-Type"], original and int(original), body if payloads and h["WARC-Type"] == "response" else None))
                    held += 100 + len(body) * payloads
                    if held > _OUT_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def restore_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload) of every record, revisits joined to the responses that they refer to."""
    records = read_archives(spark, path, payloads=True)
    originals = records.filter("record_type = 'response'").dropDuplicates(["page_id"]).select(F.col("page_id").alias("refers_to"), F.col("payload").alias("_payload"))
    whole = records.filter("record_type = 'response'").select("page_id", "payload")
    return whole.unionByName(records.filter("record_type = 'revisit'").drop("payload").join(originals, "refers_to", "left").select("page_id", F.col("_payload").alias("payload")))


def warc_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages into archives in the shared folder and read them back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes,
 translate(to_base(('0x' || substr(hex, 1, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(hex, 6, 5))::BIGINT, 32, 4)
 || to_base(('0x' || substr(hex, 11, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(hex, 16, 5))::BIGINT, 32, 4)
 || to_base(('0x' || substr(hex, 21, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(hex, 26, 5))::BIGINT, 32, 4)
 || to_base(('0x' || substr(hex, 31, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(hex, 36, 5))::BIGINT, 32, 4),
 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
 CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id < original THEN original END AS refers_to FROM m
"""
