"""Every catalog query with SQL against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

from cairn.plans.catalog_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [p.rsplit("/", 1)[1].removesuffix(".parquet") for p in glob.glob(f"{SF}/*.parquet")]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    theirs = duck.sql(ORACLES[name])
    columns = sorted(theirs.columns)
    ours = QUERIES[name](spark, SF)
    assert sorted(ours.columns) == columns
    rows = sorted((tuple(map(str, r)) for r in ours.select(*columns).collect()))
    assert rows == sorted(tuple(map(str, r)) for r in theirs.select(*columns).fetchall()) and rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_catalog_files_hold_the_whole_store(spark):
    """The tree of files grows with the tables; its references are those of the tables, its objects the catalogs."""
    rows = lambda name, *columns: sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())
    walked = [h for h, _ in rows("catalog_closure", "hex", "depth")]
    want = rows("extract_content_hashes", "hex", "suffix") + rows("chunk_hash_join", "hex", "suffix") + [(h, "C") for h in walked]
    assert rows("catalog_parse_sqlite", "hex", "suffix") == sorted(want) and len(walked) > 150
    assert rows("inventory_listing", "full_hash", "suffix") == [(h + "C", "C") for h in walked]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
