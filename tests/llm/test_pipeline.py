import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import pipeline, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The tables before and after each stage on the smallest documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for step in steps[:-1]:
        assert step.columns == steps[0].columns
    assert 4 <= len(pipeline.STAGES) <= 5


def test_quality_keeps_good_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = texts(steps[1])
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in left for d in good) >= 0.97 * len(good) and sum(d in left for d in bad) <= 0.2 * len(bad) + 1


def test_one_document_of_each_group_stays(steps):
    from test_duplicates import brute_components

    before = texts(steps[1])
    ids = sorted(before)
    roots = {ids[i] for i, _, r in brute_components([before[d] for d in ids]) if i == r}
    assert set(texts(steps[2])) == roots


def test_repeats_are_cut(steps):
    """The sentence rule by brute force; what differs from it has lost words of a stretch of 25 that an earlier document
    has too, and no stretch of 51 words is left in two documents."""
    from test_duplicates import brute_cut, stretches

    before, after = texts(steps[2]), texts(steps[3])
    want = {d: t for d, (t, n) in brute_cut(list(before.items())).items() if not n or t}
    seen, short = set(), set()
    for d in sorted(want):
        here = stretches(want[d] or "", 25)
        if after.get(d) != want[d]:
            assert len(here & short) or len(here) < len((want[d] or "").split()) - 24
            left = iter((want[d] or "").split())
            assert all(w in left for w in (after.get(d) or "").split() if len(w) > 3 and w.isalpha())
        short |= here
        long = stretches(after.get(d) or "")
        assert not long & seen
        seen |= long
    assert set(after) <= set(want) and sum(after.get(d) != t for d, t in want.items()) < 0.2 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect() if r["text"] != before[r["doc_id"]])


def test_leaks_go(spark, steps):
    from test_duplicates import brute_hits

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = texts(steps[3])
    assert set(texts(steps[4])) == {d for d, _, hit, _ in brute_hits(list(before.items()), items) if not hit}


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(steps[4])) and rows
    for r in rows:
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["exact"]


def test_odd_rows_pass_every_stage(spark, docs_of, tmp_path):
    draw = random.Random(1)
    say = lambda n: " ".join("".join(draw.choice("aeioustrn") for _ in range(5)) for _ in range(n)) + "."
    docs = docs_of([say(60), None, "", say(60), "word", say(3000)], ids=[1, 2, None, None, 4, 5]).withColumn("digest", F.lit("extra"))
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, say(12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        step = start
        for _, stage in pipeline.STAGES:
            step = stage(spark, step, folder)
        assert step.count() == start.count() and "digest" in step.columns


def test_queries_are_registered():
    names = list(queries.QUERIES)
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_give_back_their_scratch_tables(spark, steps):
    """After a stage is built only what its output reads is left in the shared folder."""
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda name: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(f"{base}/{name}") for f in files if not f.endswith("crc"))
    for stage, kept in ((pipeline.drop_near_duplicates, {"others"}), (pipeline.drop_contaminated, {"leaks"}), (pipeline.cut_repeats, {"sentences-cut", "repeated", "places"})):
        before = set(os.listdir(base))
        out = stage(spark, steps[3], SF)
        made = [n for n in os.listdir(base) if n not in before]
        large = [n for n in made if n.rsplit("-", 1)[0] not in kept and size(n) > 2_000]
        assert not large and sum(n.startswith("repeated-") and size(n) > 2_000 for n in made) <= 1
        assert out.count() > 0
