import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import bpe, token_counts
from cairn.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello world", "Hello world", "don't  stop\n\n\tnow ", "x<|endoftext|>y<|endoftext|>", "<|endoftext|", "é ü 漢字 🙂 ՘ ࢏", "a" * 3000, " " * 3000, "\x00\x01", "ab" * 40_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, docs_of, library):
    cache = scratch(spark, "cache")
    got = token_counts.count_tokens(docs_of(TEXTS), PATH, cache)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == {i: (len((t or "").encode()), len(ids_of(library, t))) for i, t in enumerate(TEXTS)}
    assert token_counts.cached(spark, cache).count() == len({t or "" for t in TEXTS})


def test_known_digests_come_from_the_cache(spark, docs_of):
    cache = scratch(spark, "cache")
    docs = docs_of(["one", "two words"])
    token_counts.count_tokens(docs, PATH, cache)
    stored = token_counts.cached(spark, cache).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    poisoned = scratch(spark, "cache")
    spark.createDataFrame(stored, token_counts.CACHE).write.parquet(poisoned)
    more = docs_of(["one", "new", "new"])
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(more, PATH, poisoned).collect()) == [1, 1, 101]
    assert token_counts.cached(spark, poisoned).count() == 3
    # another tokenizer's version shares nothing
    other = token_counts.count_tokens(more, public_tokenizers.path("piece_bpe_32k.model"), poisoned)
    assert other.where("n_tokens > 90").count() == 0 and token_counts.cached(spark, poisoned).count() == 5


def test_odd_tables(spark, docs_of):
    nothing = token_counts.count_tokens(docs_of([]), PATH, scratch(spark, "cache"))
    assert nothing.count() == 0
    rows = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (1, None, "y")], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(rows, PATH, scratch(spark, "cache"), keep=("doc_id", "n_tokens"))
    assert got.count() == 3 and got.columns == ["doc_id", "n_bytes", "content_digest", "n_tokens"] and sorted(r["n_tokens"] for r in got.collect()) == [0, 2, 2]


def test_encoding_and_decoding(spark, docs_of, library):
    coded = bpe.decode(bpe.encode(docs_of(TEXTS).withColumn("ids", F.lit("clash")), PATH), PATH)
    for r in coded.collect():
        want = ids_of(library, TEXTS[r["doc_id"]])
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs_of([]), PATH).count() == 0
    broken = spark.createDataFrame([([50256, 447],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(broken, PATH).collect()] == [library.decode([50256, 447], skip_special_tokens=False), ""]


def plain_merge(ids, ranks, merged):
    while True:
        best = min(((ranks.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return ids
        ids = ids[: best[1]] + [merged[best[0]]] + ids[best[1] + 2 :]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 10**6))
def test_segment_tree_merges_as_a_plain_search(ids, seed):
    draw = random.Random(seed)
    ranks, merged = {}, []
    for _ in range(12):
        pair = draw.randrange(4 + len(merged)) << 20 | draw.randrange(4 + len(merged))
        if pair not in ranks:
            ranks[pair] = len(merged)
            merged.append(4 + len(merged))
    assert bpe.merge(list(ids), ranks, merged) == plain_merge(list(ids), ranks, merged)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=2, max_size=17), min_size=1, max_size=20), st.integers(0, 10**6))
def test_trees_side_by_side_merge_as_a_plain_search(pieces, seed):
    draw = random.Random(seed)
    ranks, merged = {}, []
    for _ in range(12):
        pair = draw.randrange(4 + len(merged)) << 20 | draw.randrange(4 + len(merged))
        if pair not in ranks:
            ranks[pair] = len(merged)
            merged.append(4 + len(merged))
    ids, n = bpe.merge_all(np.array(sum(pieces, [])), np.array([len(x) for x in pieces]), 16, bpe.Ranks(ranks), np.array(merged))
    ends = np.cumsum(n).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [plain_merge(list(x), ranks, merged) for x in pieces]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    coder = bpe.ByteBpe(PATH)
    whole = bpe.ByteBpe(PATH)
    whole.memo = dict.fromkeys([])
    for i in range(60):
        text = " ".join(str(x) for x in range(i, i + 4))
        ids, starts = coder.encode([text, None, text])
        assert ids[starts[2] :].tolist() == ids[: starts[1]].tolist() == whole.encode([text])[0].tolist()
        assert len(coder.memo) <= 20


def test_round_trip(spark, docs_of, library):
    names = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256", "exact")
    for r in bpe.round_trip(docs_of(TEXTS).withColumn("exact", F.lit("clash")), PATH, outputs=names).collect():
        want = ids_of(library, TEXTS[r["doc_id"]])
        decoded = library.decode(want, skip_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["ids"], r["n_tokens"], r["ids_sha256"]) == (want, len(want), sha(",".join(map(str, want))))
        assert (r["decoded"], r["decoded_sha256"], r["exact"]) == (decoded, sha(decoded), True)
