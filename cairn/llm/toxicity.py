"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is sigmoid(bias + sum of its words' weights), where
a word counts as itself and as its first bytes; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels: the likelihood of theirs
trains the words' weights, which then tell which sentences offend.

The model is fitted on about `per_label` rows of each label (the documented bound), drawn by a hash of the key; the
sample of labels is bounded and broadcast, sentences are cut and hashed in tasks, the fit runs on the driver. Scoring
is one pass without a shuffle.

Edge cases: null and empty texts have no sentences and score 0; rows with a null label or key don't train; with fewer
than two labels every text scores 0; repeated rows are kept, and one of them trains; other columns than those in `keep`
are ignored, and kept ones with an output's name are replaced; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cairn.llm.textkernel import LOWER, NOT_ALNUM, hashes, slices, words

BITS = 18
PER_LABEL = 2000
#: A word must stand in so many documents of the sample to have a weight.
LEAST_DOCS = 4
#: Standard deviations by which a word's toxic documents must differ from its share, else it has no weight either.
SURPRISE = 6.0
#: Bytes of a word's beginning, a feature of longer words.
PREFIX = 4
STEPS, RATE, PENALTY, START = 200, 0.1, 1e-5, -6.0
_STOP = np.isin(np.arange(256), [10, 13, 33, 46, 63])  # line ends, ! . ?


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first bucket of each sentence, text of each sentence, begin, end in bytes); sentences have words.

    Each word has two buckets: of itself and of its beginning, the latter 0 (which has no weight) for short words.
    """
    hashed, starts, ends, _ = words(data, offsets, NOT_ALNUM)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    cuts = np.union1d(np.flatnonzero(_STOP[data]) + 1, offsets)
    part = np.searchsorted(cuts, starts, "right")
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    text = np.searchsorted(offsets, starts[first], "right") - 1
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    buckets = np.zeros((len(starts), 2), np.int64)
    buckets[:, 0] = hashed >> np.uint64(64 - BITS)
    long = np.flatnonzero(ends - starts > PREFIX)
    buckets[long, 1] = (hashes(LOWER[data], starts[long], starts[long] + PREFIX) ^ np.uint64(1 << 63)) >> np.uint64(64 - BITS)
    return buckets.ravel(), 2 * first, text, starts[first], np.minimum(cuts[np.minimum(part[last], len(cuts) - 1)], offsets[text + 1])


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.bias + np.add.reduceat(self.weights[buckets], first) if len(first) else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def log_clean(logits: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(logit))."""
    return -np.logaddexp(0, logits)


def fit(buckets: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Noisy-or likelihood by Adam with soft thresholds. bag: the document of each sentence, ascending; y: 0 or 1."""
    n = 1 << BITS
    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(buckets))))
    pairs = np.unique(bag[of_word] * n + buckets)
    in_docs = np.bincount(pairs % n, minlength=n)
    in_toxic = np.bincount(pairs % n, y[pairs // n], minlength=n)
    share = y.mean()
    surprise = (in_toxic - in_docs * share) / np.sqrt(np.maximum(in_docs * share * (1 - share), 1e-9))
    in_docs[0] = 0
    common = (in_docs >= LEAST_DOCS) & (np.abs(surprise) >= SURPRISE)
    used = np.flatnonzero(common)
    place = np.full(n, -1)
    place[used] = np.arange(len(used))
    kept = place[buckets] >= 0
    word, sentence = place[buckets][kept], of_word[kept]
    counts = np.bincount(y.astype(int), minlength=2)
    each = (1 / (2 * np.maximum(counts, 1)))[y.astype(int)]
    w, b = np.zeros(len(used)), START
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[word], len(first))
        clean = np.bincount(bag, log_clean(z), len(y))  # log P(no sentence offends)
        odds = np.exp(clean) / np.maximum(-np.expm1(clean), 1e-6)
        # label 0 wants `clean` high, label 1 low
        dz = np.where(y > 0, -odds, 1.0)[bag] * each[bag] * sigmoid(z)
        grad = np.append(np.bincount(word, dz[sentence], len(used)) + PENALTY * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(n)
    weights[used] = w
    return ToxicityModel(weights.astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """A model from docs joined with labels (0 or 1) on the key."""
    known = labels.select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_y")).where("_key is not null and _y is not null")
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -40.0)
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col("_y") == value) & (F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1, per_label / n)))))
    sample = F.broadcast(known.where(chosen).dropDuplicates(["_key"]))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(sample, F.col("_doc") == F.col("_key"))
    # of rows with one key the one of the least hash trains, so the sample is bounded whatever repeats
    rows = rows.groupBy("_doc").agg(F.first("_y").alias("_y"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(2)):
                buckets, first, owner, _, _ = sentences(data, offsets)
                at = np.searchsorted(owner, np.arange(end - start + 1))
                firsts = np.append(first, len(buckets))
                ids = [buckets[firsts[at[i]] : firsts[at[i + 1]]].astype(np.int32).tobytes() for i in range(end - start)]
                lens = [np.diff(firsts[at[i] : at[i + 1] + 1]).astype(np.int32).tobytes() for i in range(end - start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).cast(pa.int64()), batch.column(1).slice(start, end - start), pa.array(ids, pa.binary()), pa.array(lens, pa.binary())], ["key", "y", "ids", "lens"])

    got = rows.withColumn("_doc", F.xxhash64("_doc")).mapInArrow(run, "key long, y int, ids binary, lens binary").toArrow().sort_by("key")
    y = got.column("y").to_numpy()
    lens = [np.frombuffer(x, np.int32) for x in got.column("lens").to_pylist()]
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -40.0)
    buckets = np.frombuffer(b"".join(got.column("ids").to_pylist()), np.int32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(lens))[:-1]]).astype(np.int64)
    return fit(buckets, first, np.repeat(np.arange(len(y)), [len(x) for x in lens]), y)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns `keep`, score and offending: an array of (begin, end, probability), in bytes of the UTF-8 text, of sentences of at least `least`."""
    n = len(keep)
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for start, end, data, offsets in slices(batch.column(n)):
                buckets, first, owner, begins, ends = sentences(data, offsets)
                z = model.sentence_logits(buckets, first)
                scores[start:end] = -np.expm1(np.bincount(owner, log_clean(z), end - start)) if len(z) else 0.0
                p = sigmoid(z)
                for i in np.flatnonzero(p >= least):
                    found[start + owner[i]].append({"begin": int(begins[i] - offsets[owner[i]]), "end": int(ends[i] - offsets[owner[i]]), "probability": float(p[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.clip(scores, 0, 1)), pa.array(found, pa.list_(item))], [*batch.schema.names[:n], "score", "offending"])

    kept = ", ".join(f"_keep{i} {rows.schema[i].dataType.simpleString()}" for i in range(n))
    out = rows.mapInArrow(run, f"{kept}, score double, offending array<struct<begin: bigint, end: bigint, probability: double>>")
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep) if c not in ("score", "offending")], "score", "offending")
