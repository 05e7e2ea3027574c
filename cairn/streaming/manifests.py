"""Following a repository: each new version of its manifest gives the objects that its root adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import closure, references
from cairn.sources import catalogs, manifest


def follow(spark: SparkSession, manifests: str, data_dir: str, checkpoint: str, sink: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Read text files that arrive in the folder `manifests`, a manifest each, and pass `sink` the keys (full_hash) of
    each new root's catalogs that no earlier batch had and of what else its manifest names, with the root. What has been seen is a table in `checkpoint`,
    so a restart goes on where it was; a batch that is run again gives the same keys."""
    seen_path = f"{checkpoint}/seen"
    arrived = spark.readStream.text(manifests, wholetext=True)

    def batch(found: DataFrame, number: int) -> None:
        # a manifest is a few lines, and few arrive between two batches
        for content in sorted(r["value"] for r in found.select("value").distinct().toLocalIterator()):
            fields = manifest.fields(manifest.lines_of(spark, content.encode()))
            if fields.where("key = 'C'").isEmpty():
                continue
            root = manifest.root_of(fields)
            try:
                seen = spark.read.schema("hex string, batch long").parquet(seen_path).where(F.col("batch") < number).select("hex")
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                seen = None
            walk = closure.walk_files(spark, data_dir, root, seen)
            every = references.reference_multiset(walk.catalogs, catalogs.entries(walk.rows), catalogs.chunks(walk.rows)).select("hex", "suffix")
            keys = references.reachable(every.unionByName(manifest.references(fields)))
            sink(keys, root)
            walk.catalogs.select("hex", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(seen_path)

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/offsets").trigger(availableNow=True).start()
