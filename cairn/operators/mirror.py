"""Copying a store's objects from a base URL (http, https or file) into a local store."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.keys import object_path
from cairn.operators import references
from cairn.scratch import table_of
from cairn.sources import catalogs, manifest

SECONDS = 30
FETCHED = "full_hash string, status string, bytes long, message string"


def get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=SECONDS) as answer:
        if getattr(answer, "status", 200) not in (200, None):
            raise OSError(f"{url}: status {answer.status}")
        return answer.read()


def fetch(wanted: DataFrame, base_url: str, data_dir: str, tasks: int = 8) -> DataFrame:
    """FETCHED of wanted (hex, suffix): downloaded, present (it was there) or failed. A side effect: write it once."""
    paths = wanted.select(F.concat("hex", "suffix").alias("full_hash"), object_path(F.col("hex"), F.col("suffix")).alias("path"), F.length("hex").alias("digits")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, size, message = [], [], []
            for path, digits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done, n, said, target = "downloaded", 0, None, f"{data_dir}/{path}"
                try:
                    if digits < 3:
                        raise ValueError("hash is too short")
                    if os.path.exists(target):
                        done, n = "present", os.path.getsize(target)
                    else:
                        content = get(f"{base_url}/data/{path}")
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        part = f"{target}.{os.getpid()}.part"
                        with open(os.open(part, os.O_CREAT | os.O_WRONLY, 0o644), "wb") as file:
                            file.write(content)
                        os.replace(part, target)
                        n = len(content)
                except (OSError, ValueError) as error:
                    done, said = "failed", str(error)
                status.append(done)
                size.append(n)
                message.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), pa.array(size, pa.int64()), pa.array(message, pa.string())], ["full_hash", "status", "bytes", "message"])

    return paths.repartition(tasks).mapInArrow(run, FETCHED)


def mirror(spark: SparkSession, base_url: str, target: str, tasks: int = 8) -> DataFrame:
    """Mirror a repository to `target`: its manifest, then catalogs level by level, then all that they refer to.

    The result is FETCHED, written; failed catalogs are rows of it and their subtrees stay out.
    """
    data_dir = f"{target}/data"
    os.makedirs(data_dir, exist_ok=True)
    text = get(f"{base_url}/.manifest")
    with open(f"{target}/.manifest", "wb") as file:
        file.write(text)
    lines = manifest.lines_of(spark, text)
    fields = manifest.fields(lines)
    level = spark.createDataFrame([(manifest.root_of(fields), "C")], "hex string, suffix string")
    visited, outcome, rows = level, spark.createDataFrame([], FETCHED), spark.createDataFrame([], catalogs.ROWS)
    while not level.isEmpty():
        outcome = outcome.unionByName(table_of(fetch(level, base_url, data_dir, tasks), "fetched"))
        parsed = table_of(catalogs.read_catalogs(spark, data_dir, level), "parsed")
        rows = rows.unionByName(parsed)
        below = catalogs.edges(parsed).select(F.col("child_hash").alias("hex"), F.lit("C").alias("suffix")).distinct()
        level = table_of(below.join(visited, ["hex", "suffix"], "left_anti"), "level")
        visited = visited.unionByName(level)
    content = references.content_refs(catalogs.entries(rows)).unionByName(references.chunk_refs(catalogs.entries(rows), catalogs.chunks(rows))).select("hex", "suffix")
    rest = content.unionByName(manifest.references(fields)).distinct().join(visited, ["hex", "suffix"], "left_anti")
    return outcome.unionByName(table_of(fetch(rest, base_url, data_dir, tasks), "fetched"))
