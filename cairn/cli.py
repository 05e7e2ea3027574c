"""Command line: collect garbage in a repository, or mirror one."""

from __future__ import annotations

import argparse
import json
import signal
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)
    gc = sub.add_parser("collect", help="find, and with --delete remove, objects that the root doesn't reach")
    gc.add_argument("repository", help="folder with the manifest and data/")
    gc.add_argument("--manifest")
    gc.add_argument("--root-hash")
    gc.add_argument("--delete", action="store_true")
    gc.add_argument("--no-lock", action="store_true")
    gc.add_argument("--spool-dir")
    gc.add_argument("--output", help="folder for the list of doomed keys")
    gc.add_argument("--skip-unreadable", action="store_true", help="look on past catalogs that can't be read; not with --delete")
    copy = sub.add_parser("mirror", help="copy a repository from a base URL")
    copy.add_argument("base_url")
    copy.add_argument("target")
    copy.add_argument("--jobs", type=int, default=8)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    signal.signal(signal.SIGTERM, lambda *_: sys.exit(1))  # so that locks are released on the way out
    spark = SparkSession.builder.appName("cairn").config("spark.speculation", "false").getOrCreate()
    if args.mode == "mirror":
        from cairn.operators.mirror import mirror

        done = mirror(spark, args.base_url.rstrip("/"), args.target, args.jobs)
        counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
        print(json.dumps(counts))
        return int(counts.get("failed", 0) > 0)
    from cairn.plans.collect import Settings, collect

    result = collect(spark, Settings(args.repository, args.manifest, args.root_hash, args.delete, args.spool_dir, not args.no_lock, args.output, "skip" if args.skip_unreadable else "fail"))
    print(json.dumps(result.totals))
    for row in result.by_suffix.collect():
        print(json.dumps(row.asDict()))
    return int(result.totals["errors"] > 0)


if __name__ == "__main__":
    sys.exit(main())
