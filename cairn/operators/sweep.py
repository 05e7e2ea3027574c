"""Set differences between what is present and what is reachable, and the deletion that may follow."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of marks: present in the store, reachable, reachable from a new root only.
PRESENT, REACHABLE, DELTA = 1, 2, 4
OUTCOMES = "full_hash string, suffix string, outcome string, bytes long, message string"


def candidates(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Objects that aren't reachable; all of them if nothing is."""
    return objects.join(reachable.select("full_hash"), "full_hash", "left_anti")


def retained(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    return objects.join(reachable.select("full_hash"), "full_hash", "left_semi")


def missing(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Reachable keys that aren't present."""
    return reachable.select("full_hash").join(objects.select("full_hash"), "full_hash", "left_anti")


def subtract(found: DataFrame, delta: DataFrame) -> DataFrame:
    """Candidates that a newer root doesn't protect."""
    return found.join(delta.select("full_hash").distinct(), "full_hash", "left_anti")


def protected(found: DataFrame, delta: DataFrame) -> DataFrame:
    return found.join(delta.select("full_hash").distinct(), "full_hash", "left_semi")


def marked(keys: DataFrame) -> DataFrame:
    """full_hash and marks of keys (full_hash, marks), each key once with the marks of all its rows.

    One shuffle instead of a distinct for each set and a join for each difference: which sets a key is in are bits of
    marks, so every difference of them is a filter of the result.
    """
    return keys.groupBy("full_hash").agg(F.bit_or("marks").alias("marks"))


def has(mark: int) -> Column:
    """Whether marks has the bit."""
    return F.col("marks").bitwiseAND(mark) != 0


def delete(doomed: DataFrame, *, dry_run: bool = True) -> DataFrame:
    """OUTCOMES of doomed (full_hash, suffix, file_path): dry_run, deleted, gone or error.

    A side effect: write the result once and read only that. A task that is run again finds its files gone, so turn
    speculation off, and count `gone` apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcome, size, message = [], [], []
            for path in batch.column(2).to_pylist():
                done, n, said = "dry_run", 0, None
                if not dry_run:
                    try:
                        n = os.lstat(path).st_size
                        os.remove(path)
                        done = "deleted"
                    except FileNotFoundError:
                        done, n = "gone", 0
                    except OSError as error:
                        done, n, said = "error", 0, str(error)
                outcome.append(done)
                size.append(n)
                message.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcome, pa.string()), pa.array(size, pa.int64()), pa.array(message, pa.string())], ["full_hash", "suffix", "outcome", "bytes", "message"])

    return doomed.select("full_hash", "suffix", "file_path").mapInArrow(run, OUTCOMES)


def write_list(doomed: DataFrame, path: str) -> None:
    """The keys of doomed objects as text, one on a line, in no order."""
    doomed.select(F.col("full_hash").alias("value")).write.mode("overwrite").text(path)


def sorted_keys(keys: DataFrame) -> DataFrame:
    """Distinct keys in ascending order of their bytes."""
    return keys.select("full_hash").distinct().orderBy("full_hash")
