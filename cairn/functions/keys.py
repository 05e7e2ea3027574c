"""Columns of object keys, paths, prefixes and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entry flags and the suffixes of object names with their report labels.
FLAG_DIRECTORY, FLAG_FILE, FLAG_EXTERNAL = 1, 4, 128
SUFFIXES = [("", "regular"), ("C", "catalog"), ("P", "partial chunk"), ("L", "micro-catalog"), ("H", "history"), ("X", "certificate"), ("M", "metainfo")]


def suffix_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, label, i) for i, (s, label) in enumerate(SUFFIXES)], "suffix string, label string, position int")


def hex_of(blob: Column) -> Column:
    return F.lower(F.hex(blob))


def full_hash(hexadecimal: Column, suffix: Column) -> Column:
    """The key that is sorted, deduplicated and joined."""
    return F.concat(hexadecimal, suffix)


def object_path(hexadecimal: Column, suffix: Column) -> Column:
    """Two digits, a slash and the rest with the suffix; a hash of under 3 characters stays as it is, without suffix."""
    return F.when(F.length(hexadecimal) < 3, hexadecimal).otherwise(F.concat(F.substring(hexadecimal, 1, 2), F.lit("/"), F.substr(hexadecimal, F.lit(3)), suffix))


def entry_suffix(flags: Column) -> Column:
    """L for a directory that isn't a file too, else none."""
    return F.when((flags.bitwiseAND(FLAG_DIRECTORY) != 0) & (flags.bitwiseAND(FLAG_FILE) == 0), F.lit("L")).otherwise(F.lit(""))


def is_local(flags: Column) -> Column:
    """Not external; null flags are neither."""
    return flags.bitwiseAND(FLAG_EXTERNAL) == 0


def suffix_from_name(name: Column) -> Column:
    """The last character if it is one of A-Z, known or not, else none."""
    last = F.right(name, F.lit(1))
    return F.when(F.ascii(last).between(65, 90), last).otherwise(F.lit(""))


def prefixes(spark: SparkSession) -> DataFrame:
    """The 256 directories of a store, 00 to ff."""
    return spark.range(0, 256, 1, 1).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("prefix"))


def human_bytes(size: Column) -> Column:
    """Bytes as text: whole below 1024, else one decimal of the largest fitting unit, ties to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        scaled = F.bround(size.cast("double") / float(1024**power), 1)
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}B", scaled)).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null if whole is 0."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
