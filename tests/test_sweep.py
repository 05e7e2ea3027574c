import os
import random

import pytest
from stores import Tree, blob, sha

from cairn.operators import closure, report, sweep
from cairn.operators.locks import FileLock, LockHeld, RepositoryLocks
from cairn.plans.collect import Settings, collect
from cairn.scratch import table_of
from cairn.sources import inventory
from cairn.streaming.manifests import follow


def objects(spark, names):
    from pyspark.sql import functions as F

    from cairn.functions.keys import suffix_from_name

    df = spark.createDataFrame([(n,) for n in names], "full_hash string")
    return df.select("full_hash", suffix_from_name(F.col("full_hash")).alias("suffix"), F.lit(7).cast("long").alias("size"))


def names(df):
    return sorted(r["full_hash"] for r in df.collect())


def test_candidates_and_protection(spark):
    present = objects(spark, ["aa1111", "bb2222", "cc3333", "dd4444"])
    found = sweep.candidates(present, objects(spark, ["zzzz"]))
    delta = objects(spark, ["bb2222", "dd4444", "ee5555", "bb2222"])
    assert names(sweep.subtract(found, delta)) == ["aa1111", "cc3333"]
    assert sweep.protected(found, delta).count() == 2
    assert names(sweep.candidates(present, objects(spark, []))) == names(present)
    assert names(sweep.missing(present, delta)) == ["ee5555"]
    assert names(sweep.sorted_keys(delta)) == ["bb2222", "dd4444", "ee5555"]


def test_set_laws_on_random_stores(spark):
    draw = random.Random(3)
    for _ in range(3):
        pool = [f"{draw.randrange(16**4):04x}" for _ in range(60)]
        present, reach = objects(spark, sorted(set(draw.sample(pool, 40)))), objects(spark, draw.sample(pool, 30))
        out, kept = set(names(sweep.candidates(present, reach))), set(names(sweep.retained(present, reach)))
        assert not out & set(names(reach)) and out | kept == set(names(present)) and not out & kept


def test_marks_give_the_same_sets_as_joins(spark):
    draw = random.Random(5)
    pool = [f"{draw.randrange(16**4):04x}" for _ in range(80)]
    present, reach, delta = (objects(spark, draw.choices(pool, k=50)) for _ in range(3))
    bits = ((present, sweep.PRESENT), (reach, sweep.REACHABLE), (delta, sweep.DELTA))
    keys = [df.selectExpr("full_hash", f"{bit} AS marks") for df, bit in bits]
    marks = sweep.marked(keys[0].unionByName(keys[1]).unionByName(keys[2]))
    here, old, new = (sweep.has(bit) for _, bit in bits)
    found = sweep.candidates(present.distinct(), reach)
    assert names(marks.where(here & ~old)) == names(found) and names(marks.where(here & old)) == names(sweep.retained(present.distinct(), reach))
    assert names(marks.where(here & ~old & ~new)) == names(sweep.subtract(found, delta)) and names(marks.where(here & ~old & new)) == names(sweep.protected(found, delta))
    assert names(marks.where(old & ~here)) == names(sweep.missing(present, reach.distinct()))


@pytest.mark.parametrize(("name", "most"), [("gc_candidates", 3), ("gc_retained", 3), ("missing_objects", 3), ("gc_summary", 8), ("delta_survivors", 7), ("delta_protected", 7)])
def test_a_sweep_moves_keys_once(spark, name, most):
    """Exchanges of the plan without broadcasts: chunks and entries meet once, keys once; nothing is a table in between."""
    from cairn.plans.catalog_queries import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < plan.count("Exchange ") <= most and "objects" not in plan


def test_counts_by_suffix(spark):
    found = objects(spark, ["aa1", "aa2P", "aa3P", "aa4C", "aa5L"])
    got = {r["suffix"]: (r["n"], r["bytes"], r["percent"]) for r in report.by_suffix(found, 10).collect()}
    assert got == {"": (1, 7, 10.0), "P": (2, 14, 20.0), "C": (1, 7, 10.0), "L": (1, 7, 10.0)}
    assert report.remaining_seconds(10, 0) is None and report.remaining_seconds(10, 128) == 10


def test_listing(spark, tmp_path):
    tree = Tree(tmp_path)
    tree.put("aa1111")
    tree.put("aa.hiddenP")
    tree.put("ffzzzz")
    os.makedirs(f"{tree.data}/aa/folder")
    os.makedirs(f"{tree.data}/zz")
    os.symlink("/nowhere", f"{tree.data}/aa/link")
    with open(f"{tree.data}/0b", "w"):  # not a directory: can't be listed
        pass
    listing = table_of(inventory.list_store(spark, tree.data, sizes=True), "listing")
    found = inventory.objects(listing, tree.data)
    assert names(found) == ["aa.hiddenP", "aa1111", "aalink", "ffzzzz"]
    assert {r["status"]: r["prefixes"] for r in inventory.prefix_status(listing).collect()} == {"listed": 2, "error": 1, "missing": 253}
    assert inventory.totals(found).first()["objects"] == 4


def test_deletion(spark, tmp_path):
    tree = Tree(tmp_path)
    rows = [(n, s, tree.put(n)) for n, s in (("aa1", ""), ("bb2C", "C"), ("cc3P", "P"))] + [("dd4", "", f"{tree.data}/dd/gone")]
    doomed = spark.createDataFrame(rows, "full_hash string, suffix string, file_path string")
    dry = table_of(sweep.delete(doomed), "dry")
    assert os.path.exists(rows[0][2]) and report.deletion_totals(dry).first().asDict() == {"attempted": 4, "dry_run": 4, "deleted": 0, "gone": 0, "errors": 0, "freed_bytes": 0}
    done = table_of(sweep.delete(doomed, dry_run=False), "done")
    assert not os.path.exists(rows[0][2]) and report.deletion_totals(done).first().asDict() == {"attempted": 4, "dry_run": 0, "deleted": 3, "gone": 1, "errors": 0, "freed_bytes": 21}
    assert {r["suffix"]: r["n"] for r in report.attempts_by_suffix(done).collect()} == {"": 2, "C": 1, "P": 1}


def repository(tmp_path):
    tree = Tree(tmp_path / "repo")
    root = tree.catalog("root", [(1, 0, blob("live"), 4)])
    tree.put(sha("live"))
    tree.put(sha("history") + "H")
    tree.put(sha("dead"))
    tree.put(sha("deadL") + "L")
    tree.manifest(root, f"H{sha('history')}\n", tail=f"X{sha('dead')}\n")
    return tree


def test_collection_end_to_end(spark, tmp_path):
    tree = repository(tmp_path)
    result = collect(spark, Settings(tree.folder, output=f"{tmp_path}/list"))
    assert names(result.doomed) == sorted([sha("dead"), sha("deadL") + "L"])
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/list").collect()) == names(result.doomed)
    assert result.totals["dry_run"] == 2 and result.totals["checked"] == 5
    assert collect(spark, Settings(tree.folder, delete=True, spool_dir=str(tmp_path))).totals["deleted"] == 2
    assert collect(spark, Settings(tree.folder, delete=True, spool_dir=str(tmp_path))).totals["candidates"] == 0
    with open(f"{tree.data}/{sha('root')[:2]}/{sha('root')[2:]}C", "wb") as file:
        file.write(b"broken")
    with pytest.raises(closure.CatalogError):
        collect(spark, Settings(tree.folder, delete=True, use_locks=False))
    with pytest.raises(ValueError):
        collect(spark, Settings(tree.folder, delete=True, on_error="skip"))


def test_an_object_published_meanwhile_is_protected(spark, tmp_path, monkeypatch):
    tree = repository(tmp_path)
    listed = inventory.list_store

    def publish(spark_, data_dir, **more):
        tree.put(sha("new"))
        tree.manifest(tree.catalog("root2", [(1, 0, blob("live"), 4), (2, 0, blob("new"), 4)]), f"H{sha('history')}\n")
        return listed(spark_, data_dir, **more)

    monkeypatch.setattr(inventory, "list_store", publish)
    result = collect(spark, Settings(tree.folder))
    assert names(result.protected) == sorted([sha("new"), sha("root2") + "C"])
    assert names(result.doomed) == sorted([sha("dead"), sha("deadL") + "L"])


def test_locks(tmp_path):
    a, b = RepositoryLocks(str(tmp_path)), RepositoryLocks(str(tmp_path))
    with a:
        assert a.held
        with pytest.raises(LockHeld):
            b.acquire()
    assert not a.held
    a.release()  # again
    other = FileLock(f"{tmp_path}/is_updating.lock")
    other.acquire()
    with pytest.raises(LockHeld):
        b.acquire()
    assert not b.held  # the first lock went again
    other.release()
    with b:
        assert b.held


def test_following_manifests(spark, tmp_path):
    tree = repository(tmp_path)
    arriving, got = tmp_path / "arriving", []
    arriving.mkdir()
    keep = lambda keys, root: got.append((root, names(keys)))
    (arriving / "1").write_text(f"C{sha('root')}\n")
    follow(spark, str(arriving), tree.data, str(tmp_path / "state"), keep).awaitTermination()
    new = tree.catalog("root2", [(2, 0, blob("new"), 4)], nested=[sha("root")])
    (arriving / "2").write_text(f"C{new}\n")
    follow(spark, str(arriving), tree.data, str(tmp_path / "state"), keep).awaitTermination()
    assert got == [(sha("root"), sorted([sha("root") + "C", sha("live")])), (new, sorted([new + "C", sha("new")]))]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from cairn.scratch import folder_of

    class Session:
        def __init__(self, master, base=None):
            self.set, self.conf = {"spark.master": master} | ({"spark.checkpoint.dir": base} if base else {}), self

        def get(self, name, default=None):
            return self.set.get(name, default)

    with pytest.raises(ValueError):
        folder_of(Session("spark://host:7077"), "x")
    with pytest.raises(ValueError):
        folder_of(Session("local-cluster[3,2,3000]"), "x")
    assert folder_of(Session("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
