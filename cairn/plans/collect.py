"""Two-pass garbage collection: mark, list, then mark what a newer root adds while the lock is held, then delete."""

from __future__ import annotations

import os
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import closure, references, report, sweep
from cairn.operators.locks import RepositoryLocks
from cairn.scratch import table_of
from cairn.sources import catalogs, inventory, manifest


@dataclass
class Settings:
    repository: str  # folder with the manifest and data/
    manifest: str | None = None  # its path, by default .manifest in the repository
    root_hash: str | None = None  # a root instead of the manifest's
    delete: bool = False
    spool_dir: str | None = None  # of the lock files; needed to delete with locks
    use_locks: bool = True
    output: str | None = None  # folder for the list of doomed keys
    on_error: str = "fail"

    @property
    def data_dir(self) -> str:
        return f"{self.repository}/data"

    @property
    def manifest_path(self) -> str:
        return self.manifest or f"{self.repository}/.manifest"


@dataclass
class Result:
    candidates: DataFrame
    doomed: DataFrame
    protected: DataFrame
    outcomes: DataFrame
    by_suffix: DataFrame
    totals: dict


def _mark(spark: SparkSession, settings: Settings, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(keys reachable, catalogs visited) from the manifest as it is now, with its other references."""
    extra = None
    if os.path.exists(settings.manifest_path):
        with open(settings.manifest_path, "rb") as file:
            fields = manifest.fields(manifest.lines_of(spark, file.read()))
        extra, root = manifest.references(fields), settings.root_hash or manifest.root_of(fields)
    elif settings.root_hash:
        root = settings.root_hash
    else:
        raise FileNotFoundError(settings.manifest_path)
    walk = closure.walk_files(spark, settings.data_dir, root, seen, settings.on_error)
    every = references.reference_multiset(walk.catalogs, catalogs.entries(walk.rows), catalogs.chunks(walk.rows)).select("hex", "suffix")
    keys = references.reachable(every if extra is None else every.unionByName(extra))
    return table_of(keys, "reachable"), walk.catalogs.select("hex")


def collect(spark: SparkSession, settings: Settings) -> Result:
    """Run a collection. Without `delete` nothing is changed and no lock taken.

    The listing is written before the manifest is read again, so both passes see one listing. Deleting is refused when
    nothing is reachable and when unreadable catalogs may be skipped.
    """
    if settings.delete and settings.on_error != "fail":
        raise ValueError("catalogs that can't be read mustn't be skipped when deleting")
    if settings.delete and settings.use_locks and not settings.spool_dir:
        raise ValueError("deleting with locks needs spool_dir")
    reachable, visited = _mark(spark, settings, None)
    if settings.delete and reachable.isEmpty():
        raise RuntimeError("nothing is reachable; refusing to delete everything")
    listing = table_of(inventory.list_store(spark, settings.data_dir), "listing")
    objects = inventory.objects(listing, settings.data_dir)
    found = table_of(sweep.candidates(objects, reachable), "candidates")
    any_found = not found.isEmpty()
    locks = RepositoryLocks(settings.spool_dir) if settings.delete and settings.use_locks and any_found else nullcontext()
    with locks:
        delta = _mark(spark, settings, visited)[0] if any_found else spark.createDataFrame([], "full_hash string")
        doomed = table_of(sweep.subtract(found, delta), "doomed")
        guarded = sweep.protected(found, delta)
        if settings.output:
            sweep.write_list(doomed, settings.output)
        outcomes = table_of(sweep.delete(doomed, dry_run=not settings.delete), "outcomes")
    checked = objects.count()
    status = {r["status"]: r["prefixes"] for r in inventory.prefix_status(listing).collect()}
    totals = report.deletion_totals(outcomes).first().asDict() | {"checked": checked, "candidates": found.count(), "protected": guarded.count(), "reachable": reachable.count(), "unreadable_prefixes": status.get("error", 0)}
    return Result(found, doomed, guarded, outcomes, report.by_suffix(doomed.withColumn("size", F.coalesce("size", F.lit(0))), checked), totals)
