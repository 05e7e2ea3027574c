"""What reading and writing catalog files leaves on disk."""

import contextlib
import io
import os

from stores import Tree, blob, database, sha

from cairn.operators import closure, references
from cairn.plans import catalog_queries
from cairn.sources import catalogs

SF = "/root/testdata/sf0.001"


def test_references_need_no_join_of_parsed_rows(spark, tmp_path):
    """Chunks get their entries' flags where their file is read, with the same references as by joining rows."""
    tree = Tree(tmp_path)
    twice = [(8, 0, blob("x"), 4), (8, 0, blob("y"), 68)]  # a path of two entries
    entries = [(1, 0, blob("regular"), 4), (2, 0, blob("external"), 132), (3, 0, None, 1), (4, 0, blob("dir"), 1), (5, 0, None, 68), (6, 0, b"", 4), (7, 0, blob("noflags"), None), *twice, (None, 0, blob("nowhere"), 4)]
    chunks = [(5, 0, blob("c1")), (5, 0, blob("c2")), (2, 0, blob("outside")), (99, 0, blob("orphan")), (5, 0, None), (5, 0, b""), (7, 0, blob("c7")), (8, 0, blob("c8")), (5, 1, blob("other")), (None, 0, blob("cn"))]
    leaf = tree.catalog("leaf", [(5, 0, blob("e"), 4)], [(9, 0, blob("c9"))], schema="2.3")
    root = tree.catalog("root", entries, chunks, nested=[leaf, tree.catalog("old", [(1, 0, blob("f"), 4)], [(1, 0, blob("unread"))], schema="2.3")])
    joined, read = closure.walk_files(spark, tree.data, root), closure.walk_files(spark, tree.data, root, parse=catalogs.referring)
    want = references.reference_multiset(joined.catalogs, catalogs.entries(joined.rows), catalogs.chunks(joined.rows))
    got = references.referred(read.catalogs, catalogs.entries(read.rows), catalogs.owned_chunks(read.rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r["hex"] for r in got.where("suffix = 'P'").collect()].count(sha("c8")) == 2
    assert catalogs.referring("x", database(nested=[None]))[1] == ["error"] and catalogs.referring("x", b"junk")[1] == ["error"]


def test_the_query_moves_nothing_after_its_walk(spark):
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        catalog_queries.catalog_parse_sqlite(spark, SF).explain()
    assert "Scan parquet" in plan.getvalue() and "Exchange" not in plan.getvalue() and "Join" not in plan.getvalue()


def test_small_catalogs_take_one_block(spark, tmp_path):
    names = [n for n in map(sha, map(str, range(40))) if int(n[-1], 16) % 2][:4]  # not compressed
    rows = [(n, 1, k, 0, blob(f"{k}"), 4, None) for n in names for k in range(8)] + [(n, 2, k, 0, blob(f"{k}"), 0, None) for n in names for k in range(20)]
    df = spark.createDataFrame(rows, "catalog_hash string, kind int, md5path_1 long, md5path_2 long, hash binary, flags int, child string")
    assert catalog_queries._write_catalogs(df, f"{tmp_path}/data") == 4
    assert all(os.path.getsize(f"{tmp_path}/data/{n[:2]}/{n[2:]}C") <= 4096 for n in names)


def test_rows_are_hashed_after_they_are_moved(spark, tmp_path, monkeypatch):
    """What is dealt to the tasks that write files has names, a few bytes, and no hashes."""
    moved = []
    write = catalog_queries._write_catalogs
    monkeypatch.setattr(catalog_queries, "_write_catalogs", lambda rows, *more: moved.append(rows) or write(rows, *more))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    catalog_queries._tree(spark, SF)
    longest = max(len(str(v)) for r in moved[0].limit(2000).collect() for v in r if v is not None)
    assert "hash" not in moved[0].columns and longest < 20
    assert spark.conf.get(name) == before
