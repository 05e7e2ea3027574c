"""Objects that catalogs refer to, as (hex, suffix) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.keys import entry_suffix, full_hash, hex_of, is_local

#: A chunk belongs to the entry of its path in its own catalog.
PATH = ("catalog_hash", "md5path_1", "md5path_2")


def content_refs(entries: DataFrame, *carried: str) -> DataFrame:
    """catalog_hash, hex, suffix of entries that have a hash and aren't external, and the carried columns."""
    kept = entries.where((F.length("hash") > 0) & is_local(F.col("flags")))
    return kept.select("catalog_hash", hex_of(F.col("hash")).alias("hex"), entry_suffix(F.col("flags")).alias("suffix"), *carried)


def owned_chunks(entries: DataFrame, chunks: DataFrame, on: tuple[str, ...] = PATH, *carried: str) -> DataFrame:
    """Chunks with a hash (catalog_hash, hash) and the flags and carried columns of the entries that they belong to."""
    owners = entries.select(*dict.fromkeys(("catalog_hash", *on, "flags", *carried)))
    pieces = chunks.where(F.length("hash") > 0).select(*on, "hash")
    return pieces.join(owners, list(on)).select("catalog_hash", "hash", "flags", *carried)


def chunk_refs(entries: DataFrame, chunks: DataFrame, on: tuple[str, ...] = PATH) -> DataFrame:
    """catalog_hash, hex, suffix P of chunks of entries that aren't external; a chunk without an entry is dropped."""
    return piece_refs(owned_chunks(entries, chunks, on))


def piece_refs(owned: DataFrame) -> DataFrame:
    """catalog_hash, hex, suffix P of chunks (catalog_hash, hash, flags of their entries) of entries that aren't external."""
    kept = owned.where((F.length("hash") > 0) & is_local(F.col("flags")))
    return kept.select("catalog_hash", hex_of(F.col("hash")).alias("hex"), F.lit("P").alias("suffix"))


def catalog_refs(catalogs: DataFrame) -> DataFrame:
    """catalog_hash, hex, suffix C of catalogs (hex)."""
    return catalogs.select(F.col("hex").alias("catalog_hash"), "hex", F.lit("C").alias("suffix"))


def reference_multiset(catalogs: DataFrame, entries: DataFrame, chunks: DataFrame, on: tuple[str, ...] = PATH) -> DataFrame:
    """Every reference, repeats included."""
    return catalog_refs(catalogs).unionByName(content_refs(entries)).unionByName(chunk_refs(entries, chunks, on))


def referred(catalogs: DataFrame, entries: DataFrame, owned: DataFrame) -> DataFrame:
    """reference_multiset() of chunks that have their entries' flags: nothing is joined."""
    return catalog_refs(catalogs).unionByName(content_refs(entries)).unionByName(piece_refs(owned))


def reachable(references: DataFrame) -> DataFrame:
    """The distinct keys of references."""
    return references.select(full_hash(F.col("hex"), F.col("suffix")).alias("full_hash")).distinct()


def by_suffix(references: DataFrame) -> DataFrame:
    return references.groupBy("suffix").agg(F.count("*").alias("n"))
