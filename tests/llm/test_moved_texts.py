"""How much of the texts is moved and stays on disk, and the ways beyond a broadcast."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.llm import common, decontamination, jaccard, substring_dedup


def sentence(draw, n=6):
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(n)) + "."


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def shuffled(spark):
    listed = spark._jsc.sc().statusStore().executorList(False)
    return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))


def test_substring_dedup_moves_and_keeps_only_texts_with_repeats(spark, docs_of):
    draw = random.Random(3)
    passage = " ".join(sentence(draw) for _ in range(10))
    texts = [" ".join(sentence(draw) for _ in range(32)) + (" " + passage if i < 10 else "") for i in range(400)]
    docs = common.written(docs_of(texts).repartition(4), "docs")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        left, moved = size_of(folder), shuffled(spark)
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_spans(docs).collect()}
        left, moved = size_of(folder) - left, shuffled(spark) - moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: 10 * (1 <= i < 10) for i in range(400)}
    total = sum(map(len, texts))
    assert moved < 0.75 * total and left < 0.5 * total


def test_a_sketch_loses_no_key_and_passes_few_others(spark):
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("h"))
    every = spark.range(60_000).withColumns({"slot": F.lit(1), "words": F.lit(2)})  # clashing names
    some, rest = common.sifted(every, F.xxhash64("id"), common.sketch(keys, F.col("h"), 20_000))
    some, rest = ({r["id"] for r in x.select("id").collect()} for x in (some, rest))
    assert set(range(0, 60_000, 3)) <= some and not some & rest and len(some | rest) == 60_000
    assert len(some) < 20_000 + 0.1 * 40_000
    none, whole = common.sifted(every, F.xxhash64("id"), common.sketch(keys.limit(0), F.col("h"), 0), also=F.col("id") < 5)
    assert none.count() == 5 and whole.count() == 59_995


@pytest.mark.parametrize("most", [0, 500_000])
def test_without(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    rows = spark.createDataFrame([(i, "x") for i in [*range(200), 7, None]], "key int, gone string")
    gone = spark.createDataFrame([(i,) for i in [*range(0, 200, 7), None]], "gone long")
    rows = rows.withColumnRenamed("gone", "text")
    kept = common.without(rows, "key", gone, gone.count())
    assert kept.columns == ["key", "text"]
    assert sorted(r["key"] for r in kept.collect()) == [i for i in range(200) if i % 7]


def test_operators_beyond_a_broadcast(spark, docs_of, monkeypatch):
    draw = random.Random(5)
    base = [sentence(draw, 40) for _ in range(5)]
    docs = docs_of([f"{base[i % 5]} {sentence(draw, 1)}" if i % 2 else sentence(draw, 30) for i in range(40)] + [None])
    items = spark.createDataFrame([(1, " ".join(base[0].split()[5:20])), (2, sentence(draw, 12))], "item_id long, text string")

    def results():
        return sorted(jaccard.join(docs).collect(), key=str), sorted(decontamination.decontaminate(docs, items).collect(), key=str)

    expected = results()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert results() == expected
    assert sum(r["n_hit"] > 0 for r in expected[1]) == 4 and len({r["component_id"] for r in expected[0]}) < 30
