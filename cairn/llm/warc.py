"""A content-addressed WARC archive.

Two tables make an archive: payloads (digest, payload), each payload's bytes once under its SHA-256, and records
(record_id, digest, header), each record's header exactly as a WARC file has it. Joins on the digest give the records
back, and the digest of the stored bytes is computed anew as they are read.

Among records of equal payloads of at least `least_bytes`, the one of the largest id is the response and the others
are revisits that refer to it. Groups of copies are pre-aggregated by digest, so a payload that a third of all pages
share is stored by one small task; reading back joins plain rows, which adaptive execution can split.

Edge cases: a null body is the empty payload; a null URL is an empty one and control characters in a URL are dropped;
rows of equal id and payload are equal records (all responses, if theirs is the largest id); null ids are below all
others; an empty table gives an empty archive; other columns are ignored, so clashing names do no harm. Stored bytes
without their digest, a header that declares another one, and a WARC file that is cut short are errors.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column, digits: int) -> Column:
    """Upper-case base 32 of a hexadecimal text of `digits` digits, a multiple of 5: 5 digits are 4 of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 5), 16, 32), 4, "0") for at in range(1, digits, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> None:
    """Write pages as an archive to a new folder that all executors reach."""
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    bodies = pages.select(F.unhex(digest).alias("digest"), payload.alias("payload"))
    bodies.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    rows = pages.select(
        F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"),
        F.unhex(digest).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"),
    )
    first = rows.groupBy("digest").agg(F.max("key").alias("first")).withColumnRenamed("digest", "of")
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1"), 40),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit("\r\n\r\n"),
    )
    rows.join(first, F.col("digest") == F.col("of")).select(F.col("id").alias("record_id"), "digest", lines.cast("binary").alias("header")).write.parquet(f"{folder}/records")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload, payload_bytes and payload_sha1 (bare base 32); bytes that don't have their digest are an error."""
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{folder}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.hex("digest"))))
    return stored.select("digest", "payload", checked.alias("payload_bytes"), base32(F.sha1("payload"), 40).alias("payload_sha1"))


def read_records(spark: SparkSession, folder: str, *, payload: bool = True) -> DataFrame:
    """record_id, record_type, refers_to, declared_digest, header, payload_bytes, payload_sha1 and, if asked for, payload.

    Each record carries the full payload that it stands for, revisits too. Without the payload only narrow rows are joined.
    """
    records = spark.read.schema("record_id string, digest binary, header binary").parquet(f"{folder}/records")
    bodies = read_payloads(spark, folder).withColumnRenamed("digest", "of")
    if not payload:
        bodies = bodies.drop("payload")
    text = F.col("header").cast("string")
    field = lambda name, pattern: F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)
    declared = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    sound = F.when(declared == F.col("payload_sha1"), F.col("payload_sha1")).otherwise(F.raise_error(F.concat(F.lit("a record declares another digest: "), "record_id")))
    return records.join(bodies, F.col("digest") == F.col("of")).select(
        "record_id",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:page:([^>]*)>"), F.lit("")).alias("refers_to"),
        declared.alias("declared_digest"),
        "header", "payload_bytes", sound.alias("payload_sha1"), *(["payload"] if payload else []),
    )


def records_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """record_id and record: the exact bytes of each record in a WARC file; revisits have no block."""
    whole = read_records(spark, folder)
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("record_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def split_file(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, gzip or plain. A record that is cut short or has no length is a ValueError."""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (EOFError, OSError, zlib.error) as error:
            raise ValueError(f"a WARC file can't be unpacked: {error}") from error
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at) + 4
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", content[at:end]) if end > 3 else None
        if length is None or end + int(length[1]) > len(content):
            raise ValueError(f"the WARC record at byte {at} is cut short or has no length")
        yield content[at:end], content[end : end + int(length[1])]
        at = end + int(length[1]) + 4


def read_files(files: DataFrame) -> DataFrame:
    """header and block of every record of WARC files, given as the binaryFile source reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for pair in split_file(content or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pair], ["header", "block"])

    return files.select("content").mapInArrow(run, "header binary, block binary")
