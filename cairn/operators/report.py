"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.keys import human_bytes, percent, suffix_dimension


def by_suffix(found: DataFrame, checked: int | Column) -> DataFrame:
    """suffix, label, n, bytes and percent of the checked objects, for the known suffixes that occur; found has suffix and size."""
    counted = found.groupBy("suffix").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return labelled(counted, checked)


def labelled(counted: DataFrame, checked: int | Column) -> DataFrame:
    """The columns of by_suffix() of counted suffixes (suffix, n, bytes)."""
    named = counted.join(F.broadcast(suffix_dimension(counted.sparkSession)), "suffix")
    return named.select("suffix", "label", "n", "bytes", F.round(percent(F.col("n"), F.lit(checked) if isinstance(checked, int) else checked), 6).alias("percent"))


def sweep_totals(objects: DataFrame, found: Column, guarded: Column) -> DataFrame:
    """One row: checked, retained, candidates, protected and their bytes as text; checked = retained + candidates.

    found and guarded say which objects are candidates and which are protected, so objects are read once.
    """
    size = F.coalesce(F.sum(F.when(found, F.col("size"))), F.lit(0)).cast("long")
    row = objects.agg(F.count("*").alias("checked"), F.count_if(found).alias("candidates"), size.alias("candidate_bytes"), F.count_if(guarded).alias("protected"))
    return row.select("checked", (F.col("checked") - F.col("candidates")).alias("retained"), "candidates", "protected", "candidate_bytes", human_bytes(F.col("candidate_bytes")).alias("candidate_size"))


def deletion_totals(outcomes: DataFrame) -> DataFrame:
    """One row: attempted, deleted, gone, errors and freed bytes, which only real deletions free."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcomes.agg(F.count("*").alias("attempted"), n("dry_run").alias("dry_run"), n("deleted").alias("deleted"), n("gone").alias("gone"), n("error").alias("errors"), F.coalesce(F.sum(F.when(F.col("outcome") == "deleted", F.col("bytes"))), F.lit(0)).alias("freed_bytes"))


def attempts_by_suffix(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("suffix").agg(F.count("*").alias("n"))


def histogram(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Objects of every prefix, 0 for empty ones; objects has full_hash."""
    counted = objects.groupBy(F.substring("full_hash", 1, 2).alias("prefix")).agg(F.count("*").alias("n"))
    return prefixes.join(counted, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def remaining_seconds(elapsed: float, done: int, whole: int = 256) -> float | None:
    """Estimate from the share of prefixes done; None before the first."""
    return elapsed * (whole - done) / done if done else None
