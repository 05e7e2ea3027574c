"""Queries over the derived content store, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import os
import sqlite3
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.keys import entry_suffix, human_bytes, object_path, prefixes, suffix_from_name
from cairn.operators import closure, references, report, sweep
from cairn.plans.casview import NEW_ROOT, PATH, ROOT, hashed, marked, names, sha1_of, store, two_roots
from cairn.scratch import folder_of, passing_shuffles, table_of
from cairn.sources import catalogs, inventory, manifest


def extract_content_hashes(spark, sf):
    return references.content_refs(store(spark, sf).entries)


def chunk_hash_join(spark, sf):
    s = store(spark, sf)
    return references.chunk_refs(s.entries, s.chunks, PATH)


def nested_catalog_edges(spark, sf):
    return store(spark, sf).edges.where("child_hash <> ''")


def _root(spark, name):
    return spark.range(1).select(sha1_of(name).alias("hex"))


def catalog_closure(spark, sf):
    return closure.closure(store(spark, sf).edges, _root(spark, ROOT))


def catalog_closure_recursive(spark, sf):
    return closure.closure_sql(spark, store(spark, sf).edges, hashlib.sha1(ROOT.encode()).hexdigest())


def reference_multiset(spark, sf):
    return references.by_suffix(store(spark, sf).references)


def reachable_distinct(spark, sf):
    return store(spark, sf).reachable


def reachable_by_suffix(spark, sf):
    found = store(spark, sf).reachable
    return references.by_suffix(found.select(suffix_from_name(F.col("full_hash")).alias("suffix")))


def object_paths(spark, sf):
    return store(spark, sf).references.distinct().select(F.concat("hex", "suffix").alias("full_hash"), object_path(F.col("hex"), F.col("suffix")).alias("path"))


def suffix_of_names(spark, sf):
    name = F.substr("full_hash", F.lit(3))
    return store(spark, sf).objects.select(F.substring("full_hash", 1, 2).alias("prefix"), name.alias("name"), suffix_from_name(name).alias("suffix"))


def prefix_histogram(spark, sf):
    return report.histogram(store(spark, sf).objects, prefixes(spark))


def gc_candidates(spark, sf):
    return marked(store(spark, sf)).where(sweep.has(sweep.PRESENT) & ~sweep.has(sweep.REACHABLE)).select("full_hash", "size")


def gc_retained(spark, sf):
    return marked(store(spark, sf)).where(sweep.has(sweep.PRESENT) & sweep.has(sweep.REACHABLE)).select("full_hash", "size")


def missing_objects(spark, sf):
    return marked(store(spark, sf)).where(sweep.has(sweep.REACHABLE) & ~sweep.has(sweep.PRESENT)).select("full_hash")


def _closures(spark, sf):
    """(store, catalogs of the old root, catalogs that the new root adds)."""
    s = store(spark, sf)
    edges = two_roots(spark, sf, s)
    old = closure.closure(edges, _root(spark, ROOT))
    return s, old, closure.closure(edges, _root(spark, NEW_ROOT), seen=old)


def _delta(spark, sf):
    """All objects, marked by what the old root reaches and what the new one adds."""
    s, old, added = _closures(spark, sf)
    of = lambda df, mark: df.select("hex", F.lit(mark).alias("marks"))
    return marked(s, of(old, sweep.REACHABLE).unionByName(of(added, sweep.DELTA))).where(sweep.has(sweep.PRESENT))


def delta_closure(spark, sf):
    return _closures(spark, sf)[2].select("hex")


def delta_protected(spark, sf):
    return _delta(spark, sf).where(~sweep.has(sweep.REACHABLE) & sweep.has(sweep.DELTA)).select("full_hash")


def delta_survivors(spark, sf):
    return _delta(spark, sf).where(~sweep.has(sweep.REACHABLE) & ~sweep.has(sweep.DELTA)).select("full_hash")


def deleted_by_suffix(spark, sf):
    objects = marked(store(spark, sf)).where(sweep.has(sweep.PRESENT)).withColumn("found", ~sweep.has(sweep.REACHABLE))
    size = F.coalesce(F.sum(F.when(F.col("found"), F.col("size"))), F.lit(0)).cast("long")
    counted = table_of(objects.groupBy("suffix").agg(F.count_if("found").alias("n"), size.alias("bytes"), F.count("*").alias("checked")), "counted")
    return report.labelled(counted.where("n > 0"), counted.agg(F.sum("checked")).scalar())


def gc_summary(spark, sf):
    return report.sweep_totals(_delta(spark, sf), ~sweep.has(sweep.REACHABLE) & ~sweep.has(sweep.DELTA), ~sweep.has(sweep.REACHABLE) & sweep.has(sweep.DELTA))


def human_sizes(spark, sf):
    totals = store(spark, sf).objects.groupBy("suffix").agg(F.sum("size").cast("long").alias("bytes"))
    return totals.select("suffix", "bytes", human_bytes(F.col("bytes")).alias("text"))


def _manifest_lines(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    letter = F.substring(F.lit("CBRHXMSGN"), 1, 9)
    value = F.when(F.col("n_nationkey") == 20, F.lit("--")).otherwise(F.concat(F.substr(letter, (F.col("n_nationkey") % 9 + 1).cast("int"), F.lit(1)), F.sha1(F.col("n_name").cast("binary"))))
    return nation.select(F.col("n_nationkey").alias("line"), value.alias("value"))


def manifest_fields(spark, sf):
    return manifest.fields(_manifest_lines(spark, sf))


def manifest_refs(spark, sf):
    return manifest.references(manifest_fields(spark, sf))


def content_dedup(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy(F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("hex")).agg(F.count("*").alias("copies"))


def flag_suffixes(spark, sf):
    return store(spark, sf).entries.groupBy("flags", entry_suffix(F.col("flags")).alias("suffix")).agg(F.count("*").alias("n"))


def chunked_external_sort(spark, sf):
    return sweep.sorted_keys(store(spark, sf).references.select(F.concat("hex", "suffix").alias("full_hash")))


#: Kinds of rows of a catalog, in the order in which a task reads them.
_CATALOG, _ENTRY, _CHUNK, _NESTED = range(4)


def _empty_catalog() -> bytes:
    """A catalog file without rows, which each file begins as; the smallest pages, as most catalogs are small and take whole blocks of disk."""
    db = sqlite3.connect(":memory:", isolation_level=None)
    db.executescript(
        "PRAGMA page_size = 512; CREATE TABLE properties(key TEXT, value TEXT); INSERT INTO properties VALUES('schema', '2.5');"
        "CREATE TABLE catalog(md5path_1 INTEGER, md5path_2 INTEGER, hash BLOB, flags INTEGER);"
        "CREATE TABLE chunks(md5path_1 INTEGER, md5path_2 INTEGER, hash BLOB); CREATE TABLE nested_catalogs(path TEXT, sha1 TEXT, size INTEGER);"
    )
    return db.serialize()


class _Writer:
    """Writes catalogs of a store, each under a name of this task first, so that a task that runs twice does no harm."""

    def __init__(self, folder: str):
        self.folder, self.part = folder, f"{os.path.dirname(folder)}/parts/{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.part), exist_ok=True)
        self.db, self.empty = sqlite3.connect(":memory:", isolation_level=None), _empty_catalog()

    def write(self, digest: str, rows: list[tuple]) -> None:
        """rows are (kind, md5path_1, md5path_2, hash, flags, child)."""
        self.db.deserialize(self.empty)
        self.db.execute("BEGIN")
        self.db.executemany("INSERT INTO catalog VALUES(?, ?, ?, ?)", [r[1:5] for r in rows if r[0] == _ENTRY])
        self.db.executemany("INSERT INTO chunks VALUES(?, ?, ?)", [r[1:4] for r in rows if r[0] == _CHUNK])
        self.db.executemany("INSERT INTO nested_catalogs VALUES('', ?, 0)", [r[5:] for r in rows if r[0] == _NESTED])
        self.db.execute("COMMIT")
        content = self.db.serialize()
        if int(digest[-1], 16) % 2 == 0:
            content = zlib.compress(content, 1)
        with open(self.part, "wb", buffering=0) as file:
            file.write(content)
        os.replace(self.part, f"{self.folder}/{digest[:2]}/{digest[2:]}C")


def _values(column: pa.Array) -> list:
    """column.to_pylist(), but by NumPy, which takes a tenth of the time; numbers with nulls would become floats there."""
    if column.null_count and pa.types.is_integer(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _write_catalogs(rows: DataFrame, folder: str, by: str = "catalog_hash", shown: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Writes the catalogs of rows (catalog_hash, kind, md5path_1, md5path_2, hash, flags, child), a file each, and says how many.

    Rows are dealt and sorted by catalog, their column `by`; a task streams through its own and holds one catalog's rows at a
    time. `shown` makes the columns above of rows that have been moved in a shorter form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, digest, held, done = None, None, [], 0
        for batch in batches:
            writer = writer or _Writer(folder)
            digests, *values = map(_values, batch.columns)
            found = list(zip(*values, strict=True))
            begun = [i for i, (one, before) in enumerate(zip(digests, [None, *digests], strict=False)) if one != before]
            for at, end in zip(begun, [*begun[1:], len(digests)], strict=True):
                if digests[at] != digest:
                    if held:
                        writer.write(digest, held)
                        done += 1
                    digest, held = digests[at], []
                held += found[at:end]
        if held:
            writer.write(digest, held)
            done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    for prefix in range(256):
        os.makedirs(f"{folder}/{prefix:02x}", exist_ok=True)
    dealt = rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)
    return shown(dealt.sortWithinPartitions(by)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def _tree(spark: SparkSession, sf: str) -> str:
    """The derived store's catalogs as files, written by tasks under spark.checkpoint.dir, a folder mounted on driver and
    executors; returns the folder. Root, regions, nations and customers are a file each, half of them compressed.

    Names are shuffled and hashed where they are written, and the shuffle's files go when the tree stands."""
    base = folder_of(spark, "tree")
    if not base.startswith(("file:", "/")):
        raise ValueError(f"catalog files need a mounted folder, spark.checkpoint.dir is {base}")
    folder = base.removeprefix("file://").removeprefix("file:") + "/data"
    s = names(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    owned = s.chunks.join(s.entries.select("catalog", *PATH), list(PATH))
    row = lambda df, kind, name, flags: df.select("catalog", F.lit(kind).alias("kind"), *PATH, name.alias("name"), flags.cast("int").alias("flags"))
    zero = F.lit(0)  # of what a kind doesn't have
    bare = lambda df, catalog: df.withColumns({"catalog": catalog} | {c: zero.cast("long") for c in PATH})
    every = spark.range(1).select(F.lit(ROOT).alias("child")).unionByName(s.edges.select("child"))
    rows = (
        row(s.entries, _ENTRY, F.col("name"), F.col("flags"))
        .unionByName(row(owned, _CHUNK, F.col("name"), zero))
        .unionByName(row(bare(s.edges, F.col("parent")), _NESTED, F.col("child"), zero))
        .unionByName(row(bare(every, F.col("child")), _CATALOG, none("string"), zero))
    )
    nested, digest = F.col("kind") == _NESTED, hashed(F.col("name"))
    shown = lambda df: df.select(hashed(F.col("catalog")).alias("catalog_hash"), "kind", *PATH, F.when(~nested, F.unhex(digest)).alias("hash"), "flags", F.when(nested, digest).alias("child"))
    with passing_shuffles(spark):
        _write_catalogs(rows, folder, "catalog", shown)
    return folder


def catalog_parse_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the derived store's catalogs, walked as files from the root."""
    walk = closure.walk_files(spark, _tree(spark, sf_dir), hashlib.sha1(ROOT.encode()).hexdigest(), parse=catalogs.referring)
    return references.referred(walk.catalogs, catalogs.entries(walk.rows), catalogs.owned_chunks(walk.rows)).select("hex", "suffix")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.objects(table_of(inventory.list_store(spark, folder, sizes=True), "listing"), folder)


def inventory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the same tree."""
    return _listed(spark, _tree(spark, sf_dir)).select("prefix", "full_hash", "suffix", (F.col("size") > 0).alias("sized"))


def delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog files that an older root doesn't reach, deleted from the same tree: outcomes by suffix, the bytes freed
    against those that the listing said, and how many files are left."""
    folder = _tree(spark, sf_dir)
    s = store(spark, sf_dir)
    old = closure.closure(two_roots(spark, sf_dir, s), _root(spark, ROOT))
    objects = _listed(spark, folder)
    doomed = sweep.candidates(objects, references.reachable(references.catalog_refs(old)))
    outcomes = table_of(sweep.delete(doomed, dry_run=False), "outcomes")
    left = _listed(spark, folder).agg(F.count("*")).scalar()
    sizes = outcomes.join(objects.select("full_hash", "size"), "full_hash")
    return sizes.groupBy("outcome", "suffix").agg(F.count("*").alias("n"), (F.sum("bytes") == F.sum("size")).alias("as_listed")).withColumn("files_left", left)


QUERIES = {
    f.__name__: f
    for f in (
        extract_content_hashes, chunk_hash_join, nested_catalog_edges, catalog_closure, catalog_closure_recursive, reference_multiset, reachable_distinct, reachable_by_suffix,
        object_paths, suffix_of_names, prefix_histogram, gc_candidates, gc_retained, missing_objects, delta_closure, delta_protected, delta_survivors, deleted_by_suffix,
        gc_summary, human_sizes, manifest_fields, manifest_refs, content_dedup, flag_suffixes, chunked_external_sort, catalog_parse_sqlite, inventory_listing, delete_outcomes,
    )
}

_K = lambda name, column: f"sha1('{name}:' || CAST({column} AS VARCHAR))"
_VIEWS = f"""
WITH RECURSIVE edges AS (
  SELECT sha1('root') AS parent_hash, {_K("region", "r_regionkey")} AS child_hash FROM region
  UNION ALL SELECT {_K("region", "n_regionkey")}, {_K("nation", "n_nationkey")} FROM nation
  UNION ALL SELECT {_K("nation", "c_nationkey")}, {_K("customer", "c_custkey")} FROM customer),
entries AS (
  SELECT {_K("customer", "o_custkey")} AS cat, o_orderkey AS p, {_K("order", "o_orderkey")} AS h,
    CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 68 ELSE 132 END AS flags FROM orders
  UNION ALL SELECT {_K("nation", "s_nationkey")}, -1 - s_suppkey, CASE WHEN s_acctbal >= 0 THEN {_K("supplier", "s_suppkey")} END, 1 FROM supplier),
chunks AS (SELECT l_orderkey AS p, sha1('chunk:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)) AS h FROM lineitem),
content AS (SELECT cat, h, CASE WHEN (flags & 1) <> 0 AND (flags & 4) = 0 THEN 'L' ELSE '' END AS suffix FROM entries WHERE h IS NOT NULL AND (flags & 128) = 0),
pieces AS (SELECT e.cat, c.h, 'P' AS suffix FROM chunks c JOIN entries e ON c.p = e.p WHERE (e.flags & 128) = 0),
refs AS (
  SELECT sha1('root') AS h, 'C' AS suffix UNION ALL SELECT child_hash, 'C' FROM edges
  UNION ALL SELECT h, suffix FROM content UNION ALL SELECT h, suffix FROM pieces),
reach AS (SELECT DISTINCT h || suffix AS full_hash FROM refs),
inv AS (SELECT DISTINCT full_hash FROM (
  SELECT full_hash FROM reach WHERE substr(full_hash, 40, 1) <> '0'
  UNION ALL SELECT c.h || 'P' FROM chunks c JOIN entries e ON c.p = e.p WHERE (e.flags & 128) <> 0
  UNION ALL SELECT {_K("part", "p_partkey")} || CASE p_size % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'H' WHEN 2 THEN 'X' ELSE '' END FROM part)),
objects AS (SELECT full_hash, CASE WHEN ascii(right(full_hash, 1)) BETWEEN 65 AND 90 THEN right(full_hash, 1) ELSE '' END AS suffix,
  CAST(length(full_hash) * 7 AS BIGINT) AS size FROM inv),
cand AS (SELECT * FROM objects WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.full_hash = objects.full_hash)),
edges2 AS (
  SELECT sha1('root') AS parent_hash, {_K("region", "r_regionkey")} AS child_hash FROM region WHERE r_regionkey < 4
  UNION ALL SELECT sha1('root2'), {_K("region", "r_regionkey")} FROM region
  UNION ALL SELECT parent_hash, child_hash FROM edges WHERE parent_hash <> sha1('root')),
walk AS (SELECT sha1('root') AS hex, 0 AS depth UNION ALL SELECT e.child_hash, w.depth + 1 FROM walk w JOIN edges e ON e.parent_hash = w.hex),
old_c AS (SELECT sha1('root') AS hex UNION SELECT e.child_hash FROM old_c o JOIN edges2 e ON e.parent_hash = o.hex),
new_c AS (SELECT sha1('root2') AS hex UNION SELECT e.child_hash FROM new_c o JOIN edges2 e ON e.parent_hash = o.hex),
delta_c AS (SELECT hex FROM new_c EXCEPT SELECT hex FROM old_c),
r_old AS (SELECT hex || 'C' AS full_hash FROM old_c UNION SELECT h || suffix FROM content WHERE cat IN (SELECT hex FROM old_c)
  UNION SELECT h || suffix FROM pieces WHERE cat IN (SELECT hex FROM old_c)),
r_delta AS (SELECT hex || 'C' AS full_hash FROM delta_c UNION SELECT h || suffix FROM content WHERE cat IN (SELECT hex FROM delta_c)
  UNION SELECT h || suffix FROM pieces WHERE cat IN (SELECT hex FROM delta_c)),
cand_old AS (SELECT * FROM objects WHERE NOT EXISTS (SELECT 1 FROM r_old r WHERE r.full_hash = objects.full_hash)),
guarded AS (SELECT * FROM cand_old WHERE EXISTS (SELECT 1 FROM r_delta r WHERE r.full_hash = cand_old.full_hash)),
doomed AS (SELECT * FROM cand_old WHERE NOT EXISTS (SELECT 1 FROM r_delta r WHERE r.full_hash = cand_old.full_hash)),
lines AS (SELECT n_nationkey AS line, substr('CBRHXMSGN', n_nationkey % 9 + 1, 1) AS key, sha1(n_name) AS value FROM nation WHERE n_nationkey < 20),
fields AS (SELECT key, arg_max(value, line) AS value FROM lines GROUP BY key),
hexes AS (SELECT lower(lpad(printf('%x', i), 2, '0')) AS prefix FROM range(256) t(i))
"""
_SIZE = "CASE " + " ".join(f"WHEN {{0}} >= {1024**p} THEN printf('%.1f', round_even({{0}} / {1024**p}.0, 1)) || ' {u}B'" for p, u in reversed(list(enumerate("KMGTPE", 1)))) + " ELSE CAST({0} AS VARCHAR) || ' B' END"
_LABELS = "CASE suffix " + " ".join(f"WHEN '{s}' THEN '{label}'" for s, label in (("", "regular"), ("C", "catalog"), ("P", "partial chunk"), ("L", "micro-catalog"), ("H", "history"), ("X", "certificate"), ("M", "metainfo"))) + " END"

ORACLES = {
    name: f"{_VIEWS} {sql}"
    for name, sql in {
        "extract_content_hashes": "SELECT cat AS catalog_hash, h AS hex, suffix FROM content",
        "chunk_hash_join": "SELECT cat AS catalog_hash, h AS hex, suffix FROM pieces",
        "nested_catalog_edges": "SELECT parent_hash, child_hash FROM edges",
        "catalog_closure": "SELECT hex, min(depth) AS depth FROM walk GROUP BY hex",
        "catalog_closure_recursive": "SELECT hex, depth FROM walk",
        "reference_multiset": "SELECT suffix, count(*) AS n FROM refs GROUP BY suffix",
        "reachable_distinct": "SELECT full_hash FROM reach",
        "reachable_by_suffix": "SELECT CASE WHEN ascii(right(full_hash, 1)) BETWEEN 65 AND 90 THEN right(full_hash, 1) ELSE '' END AS suffix, count(*) AS n FROM reach GROUP BY 1",
        "object_paths": "SELECT DISTINCT h || suffix AS full_hash, substr(h, 1, 2) || '/' || substr(h, 3) || suffix AS path FROM refs",
        "suffix_of_names": "SELECT substr(full_hash, 1, 2) AS prefix, substr(full_hash, 3) AS name, suffix FROM objects",
        "prefix_histogram": "SELECT hexes.prefix, count(o.full_hash) AS n FROM hexes LEFT JOIN objects o ON substr(o.full_hash, 1, 2) = hexes.prefix GROUP BY hexes.prefix",
        "gc_candidates": "SELECT full_hash, size FROM cand",
        "gc_retained": "SELECT full_hash, size FROM objects WHERE EXISTS (SELECT 1 FROM reach r WHERE r.full_hash = objects.full_hash)",
        "missing_objects": "SELECT full_hash FROM reach WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.full_hash = reach.full_hash)",
        "delta_closure": "SELECT hex FROM delta_c",
        "delta_protected": "SELECT full_hash FROM guarded",
        "delta_survivors": "SELECT full_hash FROM doomed",
        "deleted_by_suffix": f"SELECT suffix, {_LABELS} AS label, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM objects), 6) AS percent FROM cand GROUP BY suffix",
        "gc_summary": f"SELECT checked, checked - candidates AS retained, candidates, protected, candidate_bytes, {_SIZE.format('candidate_bytes')} AS candidate_size FROM (SELECT (SELECT count(*) FROM objects) AS checked, (SELECT count(*) FROM doomed) AS candidates, (SELECT count(*) FROM guarded) AS protected, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM doomed) AS candidate_bytes)",
        "human_sizes": f"SELECT suffix, bytes, {_SIZE.format('bytes')} AS text FROM (SELECT suffix, CAST(sum(size) AS BIGINT) AS bytes FROM objects GROUP BY suffix)",
        "manifest_fields": "SELECT key, value FROM fields",
        "manifest_refs": "SELECT value AS hex, key AS suffix FROM fields WHERE key IN ('C', 'H', 'X', 'M')",
        "content_dedup": "SELECT sha1(coalesce(text, '')) AS hex, count(*) AS copies FROM documents GROUP BY 1",
        "flag_suffixes": "SELECT flags, CASE WHEN (flags & 1) <> 0 AND (flags & 4) = 0 THEN 'L' ELSE '' END AS suffix, count(*) AS n FROM entries GROUP BY 1, 2",
        "chunked_external_sort": "SELECT full_hash FROM reach",
        "catalog_parse_sqlite": "SELECT h AS hex, suffix FROM refs",
        "inventory_listing": "SELECT substr(hex, 1, 2) AS prefix, hex || 'C' AS full_hash, 'C' AS suffix, true AS sized FROM (SELECT DISTINCT hex FROM walk)",
        "delete_outcomes": "SELECT 'deleted' AS outcome, 'C' AS suffix, count(*) AS n, true AS as_listed, (SELECT count(*) FROM old_c) AS files_left FROM walk WHERE hex NOT IN (SELECT hex FROM old_c)",
    }.items()
}
