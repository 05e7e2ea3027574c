"""Quality grades by ordinal regression with cumulative links.

One weight vector over hashed byte n-grams is shared by all grades; ordered thresholds cut its value into grades:
P(grade > g) = sigmoid(weights . text - threshold[g]). A text gets its expected grade and, for selection, the
probability of a grade of at least `least`.

The model is fitted on a sample of rated rows, about `per_grade` of each grade (the documented bound), drawn by a hash
of the key. Ratings are narrow and the sample of them is bounded, so it is broadcast; features of the sample are made
in tasks and the fit runs on the driver. Scoring is one pass without a shuffle.

Edge cases: null and empty texts score as the text without n-grams; rows with a null or NaN rating or a null key don't train;
more than MOST_GRADES grades are an error; repeated rows are kept, and one of them trains; with fewer than two grades every text gets the one grade there is (tail probability 1, so all
are kept); all columns of the input are kept and those with the outputs' names replaced; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import with_column
from cairn.llm.textkernel import ngram_counts, slices

BITS, ORDERS = 12, (1, 2, 3)
#: Rated rows of each grade that train the model, about.
PER_GRADE = 1500
PRIOR = 300
#: Different grades at most; continuous ratings are to be binned by the caller.
MOST_GRADES = 50
#: Texts with at least this probability of a good grade are kept: junk scores near 0, while short clean texts, which
#: have little evidence either way, score near one half.
KEPT_FROM = 0.2
STEPS, RATE, PENALTY = 300, 0.2, 1e-5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of n-gram shares, at most of unit length; PRIOR n-grams of nothing keep short texts near 0."""
    counts = ngram_counts(data, offsets, ORDERS, BITS)
    return np.sqrt(counts / (counts.sum(1, keepdims=True) + PRIOR))


@dataclass
class QualityModel:
    grades: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        return 1 / (1 + np.exp(-((x @ self.weights)[:, None] - self.thresholds[None])))


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Maximum likelihood with a small L2 penalty, by Adam; each grade weighs the same."""
    grades, at = np.unique(y, return_inverse=True)
    k = len(grades)
    if k < 2:
        return QualityModel(grades if k else np.zeros(1), np.zeros(x.shape[1], np.float32), np.zeros(0))
    weight = (len(y) / (k * np.bincount(at)))[at]
    # thresholds: the first, then logarithms of the gaps, so that they stay ordered
    theta = np.concatenate([np.zeros(x.shape[1]), [-(k - 2) / 2.0], np.zeros(k - 2)])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        gaps = np.exp(theta[n + 1 :])
        cuts = theta[n] + np.concatenate([[0], np.cumsum(gaps)])
        z = x @ theta[:n].astype(np.float32)
        upper = np.where(at > 0, sigmoid(z - cuts[np.maximum(at - 1, 0)]), 1.0)  # P(grade >= own)
        lower = np.where(at < k - 1, sigmoid(z - cuts[np.minimum(at, k - 2)]), 0.0)  # P(grade > own)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        dz = -(du - dl) / len(y)
        dcuts = np.zeros(k - 1)
        np.add.at(dcuts, np.maximum(at - 1, 0), np.where(at > 0, du, 0) / len(y))
        np.add.at(dcuts, np.minimum(at, k - 2), -np.where(at < k - 1, dl, 0) / len(y))
        tail = np.cumsum(dcuts[::-1])[::-1]
        grad = np.concatenate([x.T @ dz.astype(np.float32) + PENALTY * theta[:n], [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = theta[n] + np.concatenate([[0], np.cumsum(np.exp(theta[n + 1 :]))])
    return QualityModel(grades, theta[:n].astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, *, text: str = "text", key: str = "doc_id", grade: str = "quality", per_grade: int = PER_GRADE) -> QualityModel:
    """A model from docs joined with ratings on the key."""
    rated = ratings.select(F.col(key).alias("_key"), F.col(grade).cast("double").alias("_grade")).where("_key is not null and _grade is not null")
    rated = rated.where(~F.isnan("_grade"))
    sizes = {r["_grade"]: r["n"] for r in rated.groupBy("_grade").agg(F.count("*").alias("n")).limit(MOST_GRADES + 1).collect()}
    if len(sizes) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades; ratings must be binned")
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col("_grade") == value) & (F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1, per_grade / n)))))
    sample = F.broadcast(rated.where(chosen).dropDuplicates(["_key"]))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(sample, F.col("_doc") == F.col("_key"))
    # of rows with one key the one of the least hash trains, so the sample is bounded whatever repeats
    rows = rows.groupBy("_doc").agg(F.first("_grade").alias("_grade"), F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                x = features(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([r.tobytes() for r in x], pa.binary())], ["grade", "x"])

    got = rows.mapInArrow(run, "grade double, x binary").toArrow()
    if not got.num_rows:
        return QualityModel(np.array(sorted(sizes) or [0.0])[:1], np.zeros(1 << BITS, np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(got.num_rows, -1).astype(np.float32)
    y = got.column("grade").to_numpy()
    order = np.lexsort((x[:, :8].sum(1), y))  # the fit doesn't depend on the order in which tasks end
    return fit(x[order], y[order])


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", least: float = 1.0) -> DataFrame:
    """docs with expected_grade and tail_probability, P(grade >= least)."""
    grades = model.grades
    steps = np.diff(grades)
    cut = int(np.searchsorted(grades, least))  # the first grade that is enough

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = np.full(len(batch), float(grades[0])), np.ones(len(batch))
            if len(steps):
                for first, end, data, offsets in slices(batch.column(text)):
                    above = model.above(features(data, offsets))
                    expected[first:end] += above @ steps
                    tail[first:end] = 1.0 if cut == 0 else above[:, cut - 1] if cut <= len(steps) else 0.0
            yield with_column(with_column(batch, "expected_grade", pa.array(expected)), "tail_probability", pa.array(tail))

    fields = [f for f in docs.schema.fields if f.name not in ("expected_grade", "tail_probability")]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]))
