"""What is physically present in a store: files in the directories 00 to ff, listed in groups of prefixes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.keys import prefixes, suffix_from_name

LISTING = "prefix string, name string, size long, status string"


def list_store(spark: SparkSession, data_dir: str, *, sizes: bool = False, tasks: int | None = None) -> DataFrame:
    """prefix, name, size, status: a row for each file and one, without name, for each prefix: listed, missing or error.

    Directories are left out, links and hidden names aren't. A prefix that can't be read gives no file, so nothing in
    it is ever a candidate. Sizes are looked up only if asked for. The folder must be mounted on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("prefix", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("status", pa.string())])
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                rows = []
                try:
                    with os.scandir(f"{data_dir}/{prefix}") as found:
                        rows = [(prefix, e.name, e.stat(follow_symlinks=False).st_size if sizes else None, "file") for e in found if not e.is_dir(follow_symlinks=False)]
                    rows.append((prefix, None, None, "listed"))
                except FileNotFoundError:
                    rows = [(prefix, None, None, "missing")]
                except OSError:
                    rows = [(prefix, None, None, "error")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    parts = tasks or min(256, 4 * spark.sparkContext.defaultParallelism)
    return prefixes(spark).repartition(parts).mapInArrow(run, LISTING)


def objects(listing: DataFrame, data_dir: str = "") -> DataFrame:
    """prefix, name, full_hash, file_path, suffix and size of the files of a listing."""
    return listing.where("status = 'file'").select(
        "prefix", "name", F.concat("prefix", "name").alias("full_hash"), F.concat(F.lit(f"{data_dir}/"), "prefix", F.lit("/"), "name").alias("file_path"), suffix_from_name(F.col("name")).alias("suffix"), "size"
    )


def prefix_status(listing: DataFrame) -> DataFrame:
    """How many prefixes were listed, missing or unreadable; their sum is the progress, up to 256."""
    return listing.where("status <> 'file'").groupBy("status").agg(F.count("*").alias("prefixes"))


def totals(found: DataFrame) -> DataFrame:
    """Objects and bytes in a store."""
    return found.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
