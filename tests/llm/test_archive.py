import base64
import gzip
import hashlib

import pytest

from cairn.llm import warc
from cairn.llm.common import scratch


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def archive(spark, rows, **more):
    folder = scratch(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), folder, **more)
    return folder


ROWS = [(1, "http://a", "same", "x"), (5, "http://b", "same", "x"), (3, "http://c\r\nX: y", "same", None), (7, None, None, ""), (8, "u", "", ""), (9, "v", "é" * 10, ""), (2, "w", "big" * 100_000, "")]


def test_records_come_back(spark):
    folder = archive(spark, ROWS)
    got = {r["record_id"]: r for r in warc.read_records(spark, folder).collect()}
    bodies = {str(i): (h or "").encode() for i, _, h, _ in ROWS}
    assert {k: bytes(r["payload"]) for k, r in got.items()} == bodies
    assert all(r["payload_sha1"] == r["declared_digest"] == digest(bodies[k]) and r["payload_bytes"] == len(bodies[k]) for k, r in got.items())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        "1": ("revisit", "5"), "3": ("revisit", "5"), "5": ("response", None), "7": ("revisit", "8"), "8": ("response", None), "9": ("response", None), "2": ("response", None)
    }
    assert warc.read_payloads(spark, folder).count() == 4


def test_small_payloads_are_not_merged(spark):
    got = warc.read_records(spark, archive(spark, ROWS, least_bytes=1), payload=False).collect()
    assert {r["record_id"] for r in got if r["record_type"] == "revisit"} == {"1", "3"}


def test_files_round_trip(spark, tmp_path):
    files = warc.records_as_files(spark, archive(spark, ROWS)).collect()
    whole = b"".join(bytes(r["record"]) for r in files)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    read = warc.read_files(spark.read.format("binaryFile").load(f"file://{tmp_path}"))
    assert read.count() == 2 * len(ROWS)
    assert read.where("cast(header as string) like '%X:y%'").count() == 2  # within the URL, no line of its own
    assert not any(b"\r\nX: y" in bytes(r["header"]) for r in read.collect())


def test_a_damaged_payload_is_an_error(spark):
    folder = scratch(spark, "archive")
    spark.createDataFrame([(bytes(32), b"other")], "digest binary, payload binary").write.parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_payloads(spark, folder).collect()


def test_empty_and_repeated(spark):
    assert warc.read_records(spark, archive(spark, [])).count() == 0
    twice = warc.read_records(spark, archive(spark, [(1, "u", "b", ""), (1, "u", "b", ""), (None, "u", "b", "")])).collect()
    assert sorted((r["record_id"] or "", r["record_type"], r["refers_to"]) for r in twice) == [("", "revisit", "1"), ("1", "response", None), ("1", "response", None)]


def test_damaged_files_are_errors():
    whole = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    assert list(warc.split_file(whole * 2)) == [(whole[:31], b"body")] * 2 and list(warc.split_file(b"")) == []
    for bad in (whole[:20], whole[:33], b"WARC/1.1\r\nA: b\r\n\r\n", gzip.compress(whole)[:-9]):
        with pytest.raises(ValueError):
            list(warc.split_file(bad))
