"""What the operators share: the scratch folder, written tables, documents with the columns an operator needs."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.scratch import Tables, folder_of, passing, table_of

scratch, written = folder_of, table_of
__all__ = ["SETTINGS", "BROADCAST_KEYS", "Sketch", "Tables", "asked", "passing", "prepare", "remainder", "scratch", "sifted", "sketch", "table", "utf8_bytes", "with_column", "with_field", "within", "without", "written"]

#: What the queries and the pipeline set for their session; the operators themselves set nothing and work without.
#: Batches sent to Python are bounded by bytes, whatever texts they hold; shuffle files go when their job has ended.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Keys of 8 bytes that a join broadcasts at most (4 MB).
BROADCAST_KEYS = 500_000
#: Bits of a sketch for each key, so that of other keys about 1 in 16 passes, and at most (16 MB); words of 64 bits in a row.
KEY_BITS, MOST_BITS, SLOT = 16, 1 << 27, 512


def prepare(spark: SparkSession) -> None:
    """Set SETTINGS for the session of a query."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def within(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df to be broadcast if its counted rows are at most `most`, else to be joined by shuffling."""
    return F.broadcast(df) if rows <= most else df


class Sketch(NamedTuple):
    """A bitmap of hashed keys: slots has `slot` and its SLOT `words`. Beyond MOST_BITS more other keys pass, and no key is lost."""

    slots: DataFrame
    bits: int


def sketch(keys: DataFrame, hashed: Column, rows: int) -> Sketch:
    """The sketch of `hashed` (long) over the counted rows of keys."""
    bits = 1 << (min(max(64 * SLOT, KEY_BITS * rows), MOST_BITS) - 1).bit_length()
    marked = keys.select(F.pmod(hashed, F.lit(bits)).alias("bit")).selectExpr("bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as mask")
    every = keys.sparkSession.range(bits // 64).selectExpr("id as word", "0L as mask")
    words = marked.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    slots = words.groupBy(F.expr(f"word div {SLOT}").alias("slot")).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return Sketch(slots.select("slot", F.col("words.mask").alias("words")), bits)


def sifted(df: DataFrame, hashed: Column, seen: Sketch, *, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows of df whose hash the sketch may have, and those for which `also` holds; the other rows), without a shuffle of df."""
    longer = "_" * (1 + max(map(len, df.columns)))  # than any name of df
    slots = F.broadcast(seen.slots.select(F.col("slot").alias(f"{longer}slot"), F.col("words").alias(f"{longer}words")))
    bit = F.pmod(hashed, F.lit(seen.bits))
    met = F.getbit(F.get(F.col(f"{longer}words"), F.shiftright(bit, 6) % SLOT), bit % 64) == 1
    on = (F.floor(bit / F.lit(64 * SLOT)) == F.col(f"{longer}slot")) & (met if also is None else met | also)
    return df.join(slots, on, "left_semi"), df.join(slots, on, "left_anti")


def asked(df: DataFrame, hashed: Column, keys: DataFrame, of: Column, rows: int) -> DataFrame:
    """df for a join with the counted rows of keys that keeps no others: as it is if keys are to be broadcast, else without
    most rows that have none, so that those aren't shuffled."""
    return df if rows <= BROADCAST_KEYS else sifted(df, hashed, sketch(keys, of, rows))[0]


def without(df: DataFrame, key: str, gone: DataFrame, rows: int) -> DataFrame:
    """df without the rows whose key is among the counted rows of gone, of one column `gone`; null is a key as any other.
    If those are too many to broadcast, only rows that a sketch of them leaves in doubt are shuffled."""
    same = F.col(key).eqNullSafe(F.col("gone"))
    if rows <= BROADCAST_KEYS:
        return df.join(F.broadcast(gone), same, "left_anti")
    doubtful, rest = sifted(df, F.xxhash64(F.col(key).cast(gone.schema["gone"].dataType)), sketch(gone, F.xxhash64("gone"), rows))
    return rest.unionByName(doubtful.join(gone, same, "left_anti"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo `modulus`: the fold of a row. Null values are in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def utf8_bytes(column: str):
    """Bytes of a text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema with a last column `name`, which replaces one of that name."""
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch for with_field()."""
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, name])
