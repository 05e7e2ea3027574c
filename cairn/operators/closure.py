"""Transitive closures of catalogs, over a table of edges or by opening files level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import table_of
from cairn.sources import catalogs


class CatalogError(RuntimeError):
    """Catalogs that can't be read; going on would take their live objects for garbage."""


def closure(edges: DataFrame, roots: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """hex and depth of all that roots (hex) reach over edges (parent_hash, child_hash), each once, at its least depth.

    Catalogs in `seen` (hex) and all below them only through them are left out: equal content has equal subtrees. A
    level is one job and one written table, so depth costs jobs and breadth doesn't.
    """
    edges = table_of(edges.select("parent_hash", "child_hash"), "edges")
    known = table_of(seen.select("hex").distinct(), "known") if seen is not None else None
    fresh = lambda df: df if known is None else df.join(known, "hex", "left_anti")
    level = table_of(fresh(roots.select("hex").distinct()).withColumn("depth", F.lit(0)), "level")
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = level.join(edges, level["hex"] == edges["parent_hash"]).select(F.col("child_hash").alias("hex")).where("hex <> ''").distinct()
        level = table_of(fresh(below).join(found.select("hex"), "hex", "left_anti").withColumn("depth", F.lit(depth)), "level")
        found = found.unionByName(level)
    return found


def closure_sql(spark: SparkSession, edges: DataFrame, root: str) -> DataFrame:
    """hex and depth by a recursive query: once for each path, so shared subtrees repeat. For edges that are a table.

    Spark's limits on rows and levels are lifted while it runs, and the result is written; edges with a cycle don't end,
    and the rows of one level are one job's, so large graphs with shared parts are closure()'s.
    """
    limits = {f"spark.sql.cteRecursion{x}Limit": "-1" for x in ("Row", "Level")}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        found = spark.sql(
            """WITH RECURSIVE walk(hex, depth) AS (
                 SELECT CAST(:root AS STRING), 0 UNION ALL
                 SELECT e.child_hash, w.depth + 1 FROM walk w JOIN {edges} e ON e.parent_hash = w.hex)
               SELECT hex, depth FROM walk""",
            args={"root": root},
            edges=edges,
        )
        return table_of(found, "walk")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@dataclass
class Walk:
    """A closure by files: the catalogs (hex, depth) and the rows parsed from them."""

    catalogs: DataFrame
    rows: DataFrame


def walk_files(spark: SparkSession, data_dir: str, root: str, seen: DataFrame | None = None, on_error: str = "fail", parse: Callable = catalogs.columns) -> Walk:
    """The closure of a root by opening its catalogs; `seen` prunes as in closure().

    on_error: `fail` raises CatalogError on the first level with a catalog that can't be read; `skip` leaves such
    catalogs' subtrees out and is only for looking, never for deleting.
    parse: what the rows are, catalogs.columns() or catalogs.referring().
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is fail or skip")
    known = seen.select("hex").distinct() if seen is not None else spark.createDataFrame([], "hex string")
    level = table_of(spark.createDataFrame([(root,)], "hex string").join(known, "hex", "left_anti").withColumn("depth", F.lit(0)), "level")
    visited = level
    rows = spark.createDataFrame([], catalogs.ROWS)
    depth = 0
    while not level.isEmpty():
        depth += 1
        parsed = table_of(catalogs.read_catalogs(spark, data_dir, level, parse), "parsed")
        if on_error == "fail" and (bad := catalogs.errors(parsed).take(3)):
            raise CatalogError("; ".join(f"{r['catalog_hash']}: {r['error']}" for r in bad))
        rows = rows.unionByName(parsed)
        below = catalogs.edges(parsed).select(F.col("child_hash").alias("hex")).distinct()
        level = table_of(below.join(known, "hex", "left_anti").join(visited.select("hex"), "hex", "left_anti").withColumn("depth", F.lit(depth)), "level")
        visited = visited.unionByName(level)
    return Walk(visited, rows)
