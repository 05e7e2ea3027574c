"""The registered queries of the operators: against the libraries, their SQL, or held-out figures."""

import glob
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import language_id, quality, queries, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1_equals_the_library(spark, documents, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op1_token_counts"](spark, SMALL).collect()}
    counts = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in documents.items()}
    assert got == {d: (len(documents[d].encode()), n, n > 1024) for d, n in counts.items()}


def test_op4_equals_the_library(spark, documents, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op4_bpe_codec"](spark, SMALL).collect()}
    want = {}
    for d, t in documents.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_op9_payloads(spark, documents):
    rows = queries.QUERIES["op9_media_webp"](spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    by_text = {}
    for r in rows:
        raw = documents[r["doc_id"]].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > 0
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    theirs = db.sql(queries.ORACLES[name])
    columns = sorted(theirs.columns)
    ours = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(tuple(map(str, r)) for r in ours) == sorted(tuple(map(str, r)) for r in theirs.select(*columns).fetchall())


def test_op2_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = queries.QUERIES["op2_language_id"](spark, MIDDLE).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    # a language can't be told from a few words
    judged = [r for r in rows if r["held_out"] and r["lang"] and len(r["text"] or "") >= 40]
    assert np.mean([r["lang"] == r["lang_pred"] for r in judged]) >= 0.9 and len(judged) > 100


def test_op2_scores_by_brute_force(spark, docs_of):
    texts = ["ab ab abc", "xy xyz xy", "ab xy", None, "12"]
    docs = docs_of(texts * 3).withColumn("lang", F.when(F.col("text").startswith("ab "), "p").otherwise("q"))
    model = language_id.train(docs)
    for r in language_id.predict(docs, model, keep=("text",)).distinct().collect():
        if not r["text"] or r["text"] == "12":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        raw = r["text"].encode()
        margins = model.margins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        losses = [sum(w * np.log1p(np.exp(-m * c)) for m, c, w in zip(margins, code, model.reliable, strict=True)) for code in model.code]
        shares = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert r["lang_pred"] == model.languages[int(np.argmax(shares))] and abs(r["score"] - shares.max()) < 1e-5


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_op10_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_toxicity"](spark, MIDDLE).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    judged = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    truth = [labels[r["doc_id"]] for r in judged]
    assert auc([r["score"] for r in judged], truth) >= 0.9 and len(judged) > 50


def test_op10_scores_by_brute_force(spark, docs_of):
    model = toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS, np.float32), -2.0)
    text = "Vile thing. Nice day! vile, vile"
    raw = np.frombuffer(text.encode(), np.uint8)
    buckets, first, _, _, _ = toxicity.sentences(raw, np.array([0, len(raw)]))
    model.weights[buckets[0]] = 3.0  # the word "vile"; a beginning is a feature of longer words
    (row,) = toxicity.score(docs_of([text]), model).collect()
    sentence = [1 / (1 + np.exp(-z)) for z in (-2.0 + 3.0, -2.0, -2.0 + 6.0)]
    assert abs(row["score"] - (1 - np.prod([1 - p for p in sentence]))) < 1e-6
    assert [text[x["begin"] : x["end"]] for x in row["offending"]] == ["Vile thing.", "vile, vile"]


def test_op6_on_documents_that_it_was_not_fitted_on(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    model = quality.train(docs, labels.where(~fold))
    rows = quality.score(docs.join(labels.where(fold).select("doc_id", "quality"), "doc_id"), model).collect()
    truth = [r["quality"] for r in rows]
    assert auc([r["tail_probability"] for r in rows], truth) >= 0.9 and len(rows) > 50
    for r in rows[:20]:  # the cumulative links, by hand
        raw = (r["text"] or "").encode()
        x = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        above = [1 / (1 + np.exp(-(float(x @ model.weights) - t))) for t in model.thresholds]
        assert abs(r["expected_grade"] - (model.grades[0] + sum(a * s for a, s in zip(above, np.diff(model.grades), strict=True)))) < 1e-4


def test_op6_keeps_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_quality"](spark, MIDDLE).collect()}
    good = [rows[d]["kept"] for d, q in labels.items() if q == 1]
    bad = [rows[d]["kept"] for d, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_op5_leaves_no_long_repeat(spark):
    from test_duplicates import stretches

    seen, before = set(), {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = sorted(queries.QUERIES["op5_substring_dedup"](spark, SMALL).collect(), key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        here = stretches(r["text"] or "")
        assert not here & seen, r["doc_id"]
        seen |= here
        assert r["n_removed"] > 0 or (r["text"] or "") == before[r["doc_id"]]
