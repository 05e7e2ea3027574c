import os

import pytest
from pyspark.sql import functions as F
from stores import Tree, blob, database, sha

from cairn.operators import closure, mirror, references
from cairn.sources import catalogs, manifest


def keys(df):
    return sorted(r["full_hash"] for r in references.reachable(df).collect())


def test_extraction_of_each_kind_of_entry(spark, tmp_path):
    tree = Tree(tmp_path)
    entries = [(1, 0, blob("regular"), 4), (2, 0, blob("external"), 132), (3, 0, None, 1), (4, 0, blob("dir"), 1), (5, 0, blob("bulk"), 68), (6, 0, b"", 4), (7, 0, blob("noflags"), None)]
    chunks = [(5, 0, blob("c1")), (5, 0, blob("c2")), (2, 0, blob("outside")), (99, 0, blob("orphan")), (5, 0, None)]
    root = tree.catalog("root", entries, chunks)
    rows = catalogs.read_catalogs(spark, tree.data, [root]).cache()
    content = references.content_refs(catalogs.entries(rows))
    pieces = references.chunk_refs(catalogs.entries(rows), catalogs.chunks(rows))
    assert sorted((r["hex"], r["suffix"]) for r in content.unionByName(pieces).collect()) == sorted([(sha("regular"), ""), (sha("bulk"), ""), (sha("dir"), "L"), (sha("c1"), "P"), (sha("c2"), "P")])


def test_paths_of_other_catalogs_dont_join(spark, tmp_path):
    tree = Tree(tmp_path)
    a = tree.catalog("a", [(1, 0, blob("x"), 4)], [])
    b = tree.catalog("b", [], [(1, 0, blob("chunk"))])
    rows = catalogs.read_catalogs(spark, tree.data, [a, b])
    assert references.chunk_refs(catalogs.entries(rows), catalogs.chunks(rows)).count() == 0


@pytest.mark.parametrize(("schema", "chunks"), [("2.3", 0), ("2.4", 1), ("2.5", 1), (None, 1), ("?", 1)])
def test_schema_version_decides_about_chunks(schema, chunks):
    rows = catalogs.parse("x", database([(1, 0, blob("f"), 4)], [(1, 0, blob("c"))], schema=schema))
    assert sum(r["kind"] == "chunk" for r in rows) == chunks


def test_broken_files_are_error_rows(spark):
    bad = [("empty", b""), ("junk", b"not a database"), ("torn", database()[:100])]
    files = spark.createDataFrame(bad, "catalog_hash string, content binary")
    got = {r["catalog_hash"] for r in catalogs.errors(catalogs.parse_files(files)).collect()}
    assert got == {"empty", "junk", "torn"}
    assert catalogs.parse("x", database(nested=[None]))[0]["kind"] == "error"
    assert not [r for r in catalogs.parse("x", database(nested=[""])) if r["kind"] == "nested"]


def test_wide_and_deep_trees(spark, tmp_path):
    tree = Tree(tmp_path / "wide")
    same = [(1, 0, blob("same"), 4)]
    root = tree.catalog("root", same, nested=[tree.catalog(f"n{i}", same, packed=i % 2 == 0) for i in range(10)])
    walk = closure.walk_files(spark, tree.data, root)
    every = references.reference_multiset(walk.catalogs, catalogs.entries(walk.rows), catalogs.chunks(walk.rows))
    assert walk.catalogs.count() == 11 and every.count() == 22 and len(keys(every)) == 12

    deep = Tree(tmp_path / "deep")

    def grow(name, levels):
        return deep.catalog(name, same, nested=[grow(f"{name}.{i}", levels - 1) for i in range(3)] if levels else [])

    walk = closure.walk_files(spark, deep.data, grow("r", 3))
    every = references.reference_multiset(walk.catalogs, catalogs.entries(walk.rows), catalogs.chunks(walk.rows))
    assert walk.catalogs.count() == 40 and every.count() == 80 and len(keys(every)) == 41
    assert {r["depth"]: r["count"] for r in walk.catalogs.groupBy("depth").count().collect()} == {0: 1, 1: 3, 2: 9, 3: 27}


def test_diamonds_are_walked_once_and_delta_prunes(spark, tmp_path):
    tree = Tree(tmp_path)
    leaf = tree.catalog("leaf", [(1, 0, blob("leafy"), 4)])
    a, b = tree.catalog("A", nested=[leaf]), tree.catalog("B", nested=[leaf])
    old = tree.catalog("old", nested=[a, b])
    seen = closure.walk_files(spark, tree.data, old).catalogs
    assert seen.count() == 4
    c = tree.catalog("newC", [(1, 0, blob("fresh"), 4)])
    new = tree.catalog("new", nested=[a, c])
    walk = closure.walk_files(spark, tree.data, new, seen)
    every = references.reference_multiset(walk.catalogs, catalogs.entries(walk.rows), catalogs.chunks(walk.rows))
    assert keys(every) == sorted([new + "C", c + "C", sha("fresh")])
    assert closure.walk_files(spark, tree.data, old, seen).catalogs.count() == 0


def test_a_missing_catalog_fails_the_walk(spark, tmp_path):
    tree = Tree(tmp_path)
    root = tree.catalog("root", nested=[sha("nowhere")])
    with pytest.raises(closure.CatalogError):
        closure.walk_files(spark, tree.data, root)
    walk = closure.walk_files(spark, tree.data, root, on_error="skip")
    assert walk.catalogs.count() == 2 and catalogs.errors(walk.rows).count() == 1


def test_closures_over_tables_agree(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("r", "")], "parent_hash string, child_hash string")
    loop = closure.closure(edges, spark.createDataFrame([("r",)], "hex string"))
    paths = closure.closure_sql(spark, edges.where("child_hash <> ''"), "r")
    assert paths.count() == 7  # c and d by two ways
    least = paths.groupBy("hex").agg(F.min("depth").alias("depth"))
    assert sorted(map(tuple, loop.collect())) == sorted(map(tuple, least.collect()))


def test_manifests(spark, tmp_path):
    path = tmp_path / "m"
    path.write_bytes(b"Cold\r\nCroot\nHhist\nX\nMmeta--x\nQ\n--\nXsignature\nCfake\nunterminated")
    fields = manifest.fields(manifest.read_lines(spark, f"file://{path}"))
    assert {r["key"]: r["value"] for r in fields.collect()} == {"C": "root", "H": "hist", "M": "meta--x"}
    assert manifest.root_of(fields) == "root"
    assert sorted(map(tuple, manifest.references(fields).collect())) == [("hist", "H"), ("meta--x", "M"), ("root", "C")]
    path.write_bytes(b"Hhist\n")
    with pytest.raises(ValueError):
        manifest.root_of(manifest.fields(manifest.read_lines(spark, f"file://{path}")))


def test_mirror_from_files(spark, tmp_path):
    source = Tree(tmp_path / "source")
    nested = source.catalog("nested", [(1, 0, blob("n"), 1)])
    root = source.catalog("root", [(1, 0, blob("f"), 4), (2, 0, blob("out"), 132), (3, 0, blob("lost"), 4)], nested=[nested])
    source.put(sha("f"))
    source.put(sha("n") + "L")
    source.put(sha("h") + "H")
    source.manifest(root, f"H{sha('h')}\n")
    target = tmp_path / "target"
    first = {r["full_hash"]: r["status"] for r in mirror.mirror(spark, f"file://{source.folder}", str(target)).collect()}
    assert first == {root + "C": "downloaded", nested + "C": "downloaded", sha("f"): "downloaded", sha("n") + "L": "downloaded", sha("h") + "H": "downloaded", sha("lost"): "failed"}
    assert os.path.exists(target / "data" / sha("n")[:2] / (sha("n")[2:] + "L"))
    again = {r["status"] for r in mirror.mirror(spark, f"file://{source.folder}", str(target)).collect()}
    assert again == {"present", "failed"}


def test_small_catalogs_share_a_batch_and_large_ones_are_split():
    small = list(catalogs._batches(catalogs.columns(f"c{i}", database([(1, 0, blob("f"), 4)])) for i in range(100)))
    assert len(small) == 1 and small[0].num_rows == 200
    large = database([(i, 0, blob("f"), 4) for i in range(25_000)])
    assert [b.num_rows for b in catalogs._batches([catalogs.columns("x", large)])] == [10_000, 10_000, 5_001]


def test_many_catalogs_are_read_by_many_tasks(spark, tmp_path):
    tree = Tree(tmp_path)
    rows = catalogs.read_catalogs(spark, tree.data, [tree.catalog(f"c{i}") for i in range(200)])
    used = rows.select(F.spark_partition_id().alias("task")).distinct().count()
    assert rows.count() == 200 and used > spark.sparkContext.defaultParallelism


def test_catalogs_written_by_streams_of_rows_hold_them_all(spark, tmp_path):
    """Catalogs begin and end within batches; one is larger than a batch, null hashes and flags stay null."""
    from cairn.plans.catalog_queries import _write_catalogs

    want = [(sha(f"c{i}"), 1, k, 0, blob(f"{i}.{k}") if k else None, 4 if k != 1 else None, None) for i in range(30) for k in range(1 + i * i % 40)]
    want += [(sha(f"c{i}"), 2, k, 0, blob(f"chunk {i}.{k}"), 0, None) for i in range(30) for k in range(i)] + [(sha("c0"), 3, 0, 0, None, 0, sha("c1"))]
    rows = spark.createDataFrame(want, "catalog_hash string, kind int, md5path_1 long, md5path_2 long, hash binary, flags int, child string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _write_catalogs(rows, f"{tmp_path}/data") == 30
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    read = catalogs.read_catalogs(spark, f"{tmp_path}/data", [sha(f"c{i}") for i in range(30)]).collect()
    kinds = {"entry": 1, "chunk": 2, "nested": 3}
    got = [(r["catalog_hash"], kinds[r["kind"]], r["md5path_1"] or 0, r["md5path_2"] or 0, r["hash"] and bytes(r["hash"]), r["flags"] if r["kind"] == "entry" else 0, r["child"]) for r in read if r["kind"] != "catalog"]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert os.path.getsize(f"{tmp_path}/data/{sha('c0')[:2]}/{sha('c0')[2:]}C") < 8_000
