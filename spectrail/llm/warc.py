"""A content-addressed web archive: each payload once, the headers of every record apart.

Payloads are stored under their SHA-256 in one table, record headers as exact text
in another; joining the two by digest gives the records back. Two payloads with
one SHA-256 would differ in SHA-1; writing fails on such a pair, and reading checks
each payload against its key. All of it is DataFrame functions; digest columns,
not payloads, are what is grouped.

Record ids are name-based UUIDs of the archive's own id and the record's number, so
that they are unique across archives. A revisit names its response by record id and
by page id; as it has no block, its payload comes from the store.

Defined results: a null html is an empty payload; a null or empty url writes no target
line and reads back null; line breaks in a url are percent-encoded; of records with equal payloads of at
least `min_bytes` bytes that with the largest page id (of repeated rows, the row
read last) is the response and the others revisit it; a null page id is written
without its line, sorts before all others and reads back null; a very long payload is
one cell, never gathered with others; columns other than these three play no part; an
empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common

MIN_BYTES = 0
BASE32_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
CRLF = "\r\n"
#: Fixed value of the format: what a revisit without a block of its own says.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *BASE32_DIGITS)


def record_id(archive_id: str, row: Column) -> Column:
    """The URN of a record: a UUID by name, of the archive's id and the record's number (RFC 4122, version 5)."""
    digest = F.sha1(F.concat(F.lit(uuid.UUID(archive_id).bytes), row.cast("string").cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1), F.lit(1))
    parts = (F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_text(kind: Column, row: Column, page_id: Column, url: Column, digest: Column, length: Column, refers_to: Column, response_row: Column, archive_id: str, date: str) -> Column:
    """The record's header block, without the line that ends it."""
    revisit = kind == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(archive_id, row)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.nullif(target, F.lit(""))), F.lit("")),
        F.coalesce(line("X-Page-ID", page_id), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", record_id(archive_id, response_row)))).otherwise(F.lit("")),
        F.coalesce(line("X-Refers-To-Page", refers_to), F.lit("")),
        line("Content-Length", F.when(kind == "response", length).otherwise(F.lit(0).cast("long"))),
    )


def header_field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, date: str | None = None) -> Archive:
    """Write the two tables to the shared folder; `date` (by default now, in UTC) is that of every record."""
    spark = pages.sparkSession
    archive_id, date = str(uuid.uuid4()), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    staging = common.new_path(spark, "warc-staged")
    (
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
            F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"),
            F.octet_length(payload).cast("long").alias("length"), payload.alias("payload"),
        )
        .write.option("compression", "zstd").parquet(staging)
    )
    staged = spark.read.schema("row long, page_id long, url string, sha256 string, sha1 string, length long, payload binary").parquet(staging)
    records = staged.drop("payload")
    last = F.max(F.struct("page_id", "row"))
    chosen = records.groupBy("sha256").agg(last.alias("last"), F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("length").alias("short"), F.max("length").alias("long"))
    clash = (F.col("low") != F.col("high")) | (F.col("short") != F.col("long"))
    chosen = chosen.select("sha256", F.when(clash, F.raise_error(F.lit("two payloads share a SHA-256"))).otherwise(F.col("last")).alias("last"))
    revisit = (F.col("length") >= min_bytes) & (F.col("row") != F.col("last")["row"])
    archive = Archive(common.new_path(spark, "warc-headers"), common.new_path(spark, "warc-payloads"))
    kind = F.when(revisit, "revisit").otherwise("response")
    judged = records.join(chosen, "sha256")
    judged.select(
        "sha256",
        header_text(kind, F.col("row"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("length"), F.when(revisit, F.col("last")["page_id"]), F.col("last")["row"], archive_id, date).alias("header"),
    ).write.parquet(archive.headers)
    # All rows but those with an equal payload in a later row bring their payload. These others, once written, have a
    # known size: few are broadcast and no payload is shuffled; many are joined by row number, which spreads evenly.
    surplus = common.settle(judged.where(F.col("row") != F.col("last")["row"]).select("row"), "warc-surplus")
    staged.select("row", "sha256", "payload").join(surplus, "row", "left_anti").select("sha256", "payload").write.option("compression", "zstd").parquet(archive.payloads)
    common.release(surplus)
    common.drop_path(spark, staging)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record again: its header text, fields parsed from it, and the whole payload, checked against its digests."""
    headers = spark.read.schema("sha256 string, header string").parquet(archive.headers)
    payloads = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    sound = F.sha2("payload", 256) == F.col("sha256")
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("payload doesn't match its digest")).cast("binary"))
    return headers.join(payloads, "sha256", "left").select(
        "header",
        payload.alias("payload"),
        header_field(F.col("header"), "X-Page-ID").cast("long").alias("page_id"),
        header_field(F.col("header"), "WARC-Target-URI").alias("url"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        header_field(F.col("header"), "WARC-Payload-Digest").alias("digest"),
        header_field(F.col("header"), "X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def record_bytes(record: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file; a revisit has no block."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(CRLF).cast("binary")
    return record.withColumn("bytes", F.concat(F.col("header").cast("binary"), end, block, end, end))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, rebuild each record and describe it: a response's payload is what lies between its header and its end."""
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    record = record_bytes(read_archive(spark, archive))
    block = F.octet_length("bytes") - F.octet_length("header") - 3 * len(CRLF)
    return record.select(
        "page_id", F.when(F.col("record_type") == "response", block).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to",
    )


#: Five hex digits at a time are four base32 digits.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), v AS (
  SELECT page_id, h, list_transform(range(0, 8), lambda i: ('0x' || substr(x, CAST(1 + 5 * i AS INT), 5))::BIGINT) AS g FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM v
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(g, lambda n:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (n >> 15) AS INT), 1)
   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((n >> 10) & 31) AS INT), 1)
   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((n >> 5) & 31) AS INT), 1)
   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (n & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM r
"""
