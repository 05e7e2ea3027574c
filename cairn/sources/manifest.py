"""Repository manifests: text, on each line a key character and its value, up to a line that is `--`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Manifest keys whose objects are referenced, and the suffix of each.
REFERENCES = {"C": "C", "H": "H", "X": "X", "M": "M"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of one manifest; one carriage return before a line feed is cut."""
    whole = spark.read.text(path, wholetext=True).select("value")
    return whole.select(F.posexplode(F.split("value", "\n", -1)).alias("line", "value")).select("line", F.regexp_replace("value", "\r$", "").alias("value"))


def lines_of(spark: SparkSession, content: bytes) -> DataFrame:
    """The same of a manifest's bytes. Spark's readers pass over names that begin with a dot, as manifests' do."""
    rows = [(i, x.removesuffix("\r")) for i, x in enumerate(content.decode("utf-8", "replace").split("\n"))]
    return spark.createDataFrame(rows, "line int, value string")


def fields(lines: DataFrame) -> DataFrame:
    """key and value; the last line of a key wins, lines under 2 characters and those from `--` on don't count.

    A manifest is a few lines, so finding the separator by one window is no concern.
    """
    ended = F.max(F.when(F.col("value") == "--", 1).otherwise(0)).over(W.orderBy("line"))
    body = lines.withColumn("ended", ended).where("ended = 0 and length(value) >= 2")
    keyed = body.select("line", F.substring("value", 1, 1).alias("key"), F.trim(F.expr("substring(value, 2)")).alias("value"))
    return keyed.groupBy("key").agg(F.max_by("value", "line").alias("value"))


def references(found: DataFrame) -> DataFrame:
    """hex and suffix of the root catalog, history, certificate and metainfo."""
    suffix = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    return found.where(F.col("key").isin(*REFERENCES)).select(F.col("value").alias("hex"), F.try_element_at(suffix, F.col("key")).alias("suffix"))


def root_of(found: DataFrame) -> str:
    """The root catalog's hash; a manifest without one is an error."""
    row = found.where("key = 'C'").first()
    if row is None:
        raise ValueError("the manifest names no root catalog")
    return row["value"]
