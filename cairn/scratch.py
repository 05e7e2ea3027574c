"""Tables and files between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    A single machine may go without that setting: a temporary folder is made and set. On a cluster executors would each
    write to a disk of their own, so its lack is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _PASSING:
        made.append(folder)
    return folder


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are given back at the end: each becomes an empty table. What is read later is written inside
    to Tables made outside."""
    made: list[str] = []
    _PASSING.append(made)
    try:
        yield
    finally:
        _PASSING[:] = [x for x in _PASSING if x is not made]
    for folder in made:
        spark.range(0).write.mode("overwrite").parquet(folder)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs that run inside go when their job has ended, not when the driver's collector comes by."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """Written tables of one call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, folder_of(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: lineage ends there, and a lost executor loses nothing."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Give back the space of tables whose last reader has been written: each becomes an empty table."""
        for name in names:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/{name}")


def table_of(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    return Tables(df.sparkSession, name).write(df, "table")
