"""Catalog files: SQLite databases, raw or zlib-compressed, parsed in Arrow batches without temporary files."""

from __future__ import annotations

import sqlite3
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
MAGIC = b"SQLite format 3\x00"
DEFAULT_SCHEMA, CHUNKS_SINCE = 2.5, 2.4
BATCH_ROWS = 10_000
ROWS = "catalog_hash string, kind string, md5path_1 long, md5path_2 long, hash binary, flags int, child string, schema_version double, error string"
_ARROW = pa.schema([("catalog_hash", pa.string()), ("kind", pa.string()), ("md5path_1", pa.int64()), ("md5path_2", pa.int64()), ("hash", pa.binary()), ("flags", pa.int32()), ("child", pa.string()), ("schema_version", pa.float64()), ("error", pa.string())])


def inflate(content: bytes) -> bytes:
    """The database of a file's bytes; a file that is neither SQLite nor zlib is an error, an empty one too."""
    if not content:
        raise ValueError("empty catalog file")
    if content[:16] == MAGIC:
        return content
    return zlib.decompress(content)


def open_database(content: bytes) -> sqlite3.Connection:
    data = bytearray(inflate(content))
    if data[:16] != MAGIC:
        raise ValueError("not a catalog database")
    data[18] = data[19] = 1  # a write-ahead log can't be used in memory; a checkpointed file reads without
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(data))
    return db


def schema_version(db: sqlite3.Connection) -> float:
    """The schema property, 2.5 if it is missing or no number."""
    try:
        return float(db.execute("SELECT value FROM properties WHERE key = 'schema'").fetchone()[0])
    except (sqlite3.Error, TypeError, ValueError):
        return DEFAULT_SCHEMA


def columns(catalog: str, content: bytes) -> list[list]:
    """The columns of ROWS for one file: rows of kind catalog (one), entry, chunk and nested; one of kind error if it can't be read."""
    return _read(catalog, content, "chunk", lambda entries, chunks: (entries, chunks))


def referring(catalog: str, content: bytes) -> list[list]:
    """columns() with only what references are made of, so that they need no join: entries with a hash, without their paths,
    and of kind owned chunks with a hash and the flags of their entry, one for each entry of their path."""
    return _read(catalog, content, "owned", _referring)


def _referring(entries: list[tuple], chunks: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    flags_of: dict[tuple, list] = {}
    if chunks:
        for first, second, _, flags in entries:
            if first is not None and second is not None:
                flags_of.setdefault((first, second), []).append(flags)
    owned = [(None, None, digest, flags) for first, second, digest, _ in chunks if digest for flags in flags_of.get((first, second), ())]
    return [(None, None, digest, flags) for _, _, digest, flags in entries if digest], owned


def _read(catalog: str, content: bytes, kind: str, kept: Callable[[list[tuple], list[tuple]], tuple[list[tuple], list[tuple]]]) -> list[list]:
    try:
        db = open_database(content)
        version = schema_version(db)
        entries = db.execute("SELECT md5path_1, md5path_2, hash, flags FROM catalog").fetchall()
        chunks = db.execute("SELECT md5path_1, md5path_2, hash, NULL FROM chunks").fetchall() if version >= CHUNKS_SINCE else []
        nested = [child for (child,) in db.execute("SELECT sha1 FROM nested_catalogs")]
        db.close()
        entries, chunks = kept(entries, chunks)
        if None in nested:
            raise ValueError("a nested catalog without a hash")
        nested = [child for child in nested if child]
        n = 1 + len(entries) + len(chunks) + len(nested)
        kinds = ["catalog"] + ["entry"] * len(entries) + [kind] * len(chunks) + ["nested"] * len(nested)
        none = (None,) * 4
        body = map(list, zip(none, *entries, *chunks, *[none] * len(nested), strict=True))
        return [[catalog] * n, kinds, *body, [None] * (n - len(nested)) + nested, [version] + [None] * (n - 1), [None] * n]
    except (sqlite3.Error, zlib.error, ValueError, OSError) as error:
        return _failed(catalog, f"{type(error).__name__}: {error}")


def _failed(catalog: str, error: str) -> list[list]:
    return [[catalog], ["error"], *[[None]] * 6, [error]]


def parse(catalog: str, content: bytes) -> list[dict]:
    """columns() as rows."""
    return [dict(zip(_ARROW.names, row, strict=True)) for row in zip(*columns(catalog, content), strict=True)]


def _batches(files: Iterator[list[list]]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_ROWS rows; small files share one."""
    held: list[list] = [[] for _ in _ARROW.names]
    for found in files:
        for column, more in zip(held, found, strict=True):
            column.extend(more)
        while len(held[0]) >= BATCH_ROWS:
            yield _batch([column[:BATCH_ROWS] for column in held])
            held = [column[BATCH_ROWS:] for column in held]
    if held[0]:
        yield _batch(held)


def _batch(held: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(held, _ARROW.types, strict=True)], schema=_ARROW)


def parse_files(files: DataFrame) -> DataFrame:
    """ROWS of catalog files; files has catalog_hash and content. One file is one row's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(columns(catalog, content.as_py() or b"") for batch in batches for catalog, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))

    return files.select("catalog_hash", "content").mapInArrow(run, ROWS)


def read_catalogs(spark: SparkSession, data_dir: str, hashes: list[str] | DataFrame, parse: Callable[[str, bytes], list[list]] = columns) -> DataFrame:
    """ROWS of the given catalogs of a store, as columns() or referring() makes them. A catalog without a file is a row of kind error."""
    if not isinstance(hashes, DataFrame):
        hashes = spark.createDataFrame([(h,) for h in hashes], "hex string")
    # Hashes are few bytes and their files aren't, so adaptive execution would put too many of them in a task.
    tasks = 4 * spark.sparkContext.defaultParallelism
    wanted = hashes.select(F.col("hex").alias("catalog_hash")).repartition(tasks, "catalog_hash").distinct()

    def read(catalog: str) -> list[list]:
        try:
            with open(f"{data_dir}/{catalog[:2]}/{catalog[2:]}C", "rb") as file:
                return parse(catalog, file.read())
        except OSError as error:
            return _failed(catalog, str(error))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(catalog) for batch in batches for catalog in batch.column(0).to_pylist())

    return wanted.mapInArrow(load, ROWS)


def entries(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'entry'").select("catalog_hash", "md5path_1", "md5path_2", "hash", "flags")


def chunks(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'chunk'").select("catalog_hash", "md5path_1", "md5path_2", "hash")


def owned_chunks(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'owned'").select("catalog_hash", "hash", "flags")


def edges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'nested'").select(F.col("catalog_hash").alias("parent_hash"), F.col("child").alias("child_hash"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'error'").select("catalog_hash", "error")
