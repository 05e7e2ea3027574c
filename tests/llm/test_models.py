import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import language_id, quality, toxicity

DRAW = random.Random(5)
SOUNDS = {"xx": ["ka", "lo", "mi"], "yy": ["str", "pf", "ang"], "zz": ["ou", "éa", "eux"]}


def text(lang, n=30):
    return " ".join("".join(DRAW.choice(SOUNDS[lang]) for _ in range(3)) for _ in range(n))


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 20):
        code = language_id.codewords(n)
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert near >= {2: 1, 4: 4, 7: 32, 20: 12}[n]
        assert (np.abs(code.sum(0)) < n).all()


def test_languages(spark):
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(SOUNDS) * 30)] + [(900, "no language", None), (901, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    held = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(list(SOUNDS) * 10)] + [(50, None, ""), (51, "123 !", ""), (52, "", ""), (53, text("xx", 40_000), "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(held, model, keep=("doc_id", "lang")).collect()}
    assert all(got[i]["lang_pred"] == got[i]["lang"] and 0.5 < got[i]["score"] <= 1 for i in [*range(30), 53])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (50, 51, 52))
    mixed = spark.createDataFrame([(1, "q" * 9)], "doc_id long, text string")
    assert language_id.predict(mixed, model).first()["ambiguous"] is not None
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(held, none).collect()} == {"und"}
    assert language_id.predict(held.limit(0), model).count() == 0


def test_ordinal_grades(spark):
    marks = {0: "###", 1: "...", 2: "ok"}
    rows = [(i, " ".join(DRAW.choice(["word", "more", marks[g]]) for _ in range(60)), g) for i, g in enumerate([0, 1, 2] * 60)]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows], "doc_id long, text string, expected_grade double")
    rated = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, rated)
    assert (np.diff(model.thresholds) > 0).all()
    grade = dict((i, g) for i, _, g in rows)
    got = quality.score(docs, model, least=2.0).collect()
    assert sum(abs(r["expected_grade"] - grade[r["doc_id"]]) < 0.5 for r in got) > 170
    assert sum((r["tail_probability"] > 0.5) == (grade[r["doc_id"]] == 2) for r in got) > 170
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "ok ok")], "doc_id long, text string")
    assert all(0 <= r["tail_probability"] <= 1 for r in quality.score(odd, model).collect())
    assert {r["tail_probability"] for r in quality.score(odd, quality.train(docs, rated.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(odd.limit(0), quality.train(docs.limit(0), rated)).count() == 0


def test_toxic_sentences_are_found(spark):
    words = ["sun", "tree", "river", "stone", "cloud", "bird"]
    say = lambda n: " ".join(DRAW.choice(words) for _ in range(n))
    rows = []
    for i in range(300):
        lines = [say(8) for _ in range(6)]
        if i % 3 == 0:
            lines[DRAW.randrange(6)] += DRAW.choice([" grumbly", " snarkish", " grumbled"])
        rows.append((i, ". ".join(lines) + ".", int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 240] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows)
    for i, t, y in rows:
        found = [t.encode()[o["begin"] : o["end"]].decode() for o in got[i]["offending"]]
        assert len(found) == y and all("gr" in x or "sn" in x for x in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "grumbly"), (3, "..!!"), (4, "sun " * 100_000 + "grumbly")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[2] == scores[3] == 0 and scores[None] > 0.5 and scores[4] > 0.5
    assert toxicity.score(odd.limit(0), model).count() == 0
    one_label = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_label).agg(F.max("score")).first()[0] < 1e-6


def test_bounds_and_clashing_names(spark, docs_of):
    docs = docs_of(["ab cd", "ab cd", None, "xy"], ids=[1, 1, 2, 3]).withColumn("score", F.lit("clash"))
    ratings = spark.createDataFrame([(1, float("nan")), (2, 0.0), (3, 1.0), (1, 1.0)], "doc_id long, quality double")
    assert quality.score(docs, quality.train(docs, ratings)).count() == 4
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.rand(1).alias("quality"))
    with pytest.raises(ValueError):
        quality.train(docs, many)
    with pytest.raises(ValueError):
        language_id.train(spark.range(300).select(F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang")))
    for got in (language_id.predict(docs, language_id.train(docs), keep=("doc_id", "score")), toxicity.score(docs, toxicity.train(docs, ratings.selectExpr("doc_id", "quality as toxic")), keep=("doc_id", "score"))):
        assert got.columns.count("score") == 1 and dict(got.dtypes)["score"] == "double" and got.count() == 4
