"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary n-gram classifier separates the languages whose bit is
1 from the others: its weights are log odds of hashed byte n-grams, its margin their mean over a text. Decoding adds,
over the bits, the logistic loss of the margin against each codeword's bit, weighted by how reliable the bit was on
the training texts; the nearest codeword wins, and a runner-up close behind flags the text as ambiguous.

Training counts n-grams over all training rows in one pass and measures the bits in a second; tasks pre-aggregate, so
only (language, column) sums are shuffled, and the driver gets languages x columns numbers whatever the input's size.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is everything if nothing could be
learned; repeated rows are kept; other columns of the input than those in
`keep` are ignored, and kept ones with an output's name are replaced; more than MOST_LANGUAGES languages are an error;
texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cairn.llm.textkernel import ngram_counts, slices

BITS, ORDERS = 12, (2, 3)
#: n-grams of a text that count as independent evidence at most.
EVIDENCE = 64
#: Languages at most: the driver holds a row of columns for each.
MOST_LANGUAGES = 256
#: A runner-up with at least this share of the winner's score makes a text ambiguous.
NEAR = 0.5
UNKNOWN = "und"


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1. Up to 7 classes have the exhaustive code; more have random bits, chosen for distance."""
    if classes < 2:
        return np.ones((classes, 1), np.int8)
    if classes <= 7:
        columns = np.arange(1, 1 << (classes - 1))
        return np.where((columns[None, :] >> np.arange(classes)[:, None]) & 1, 1, -1).astype(np.int8)
    length, rng, best, far = int(np.ceil(12 * np.log2(classes))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, length))
        agree = code.astype(np.int32) @ code.T
        np.fill_diagonal(agree, -length)
        near = (length - agree.max()) // 2
        if near > far and (abs(code.sum(0, dtype=np.int32)) < classes).all():
            best, far = code, near
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # columns x bits
    reliable: np.ndarray  # weight of each bit

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = ngram_counts(data, offsets, ORDERS, BITS)
        seen = counts.sum(1, keepdims=True)
        return counts @ self.weights / np.maximum(seen, 1) * np.minimum(seen, EVIDENCE)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Scores, texts x languages, that add up to 1."""
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.reliable
        shares = np.exp(losses.min(1, keepdims=True) - losses)
        return shares / shares.sum(1, keepdims=True)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from all rows of docs with a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    width = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for first, end, data, offsets in slices(batch.column(1)):
                counts = ngram_counts(data, offsets, ORDERS, BITS)
                for name in np.unique(names[first:end]):
                    total[str(name)] = total.get(str(name), 0) + counts[names[first:end] == name].sum(0, dtype=np.float64)
        for name, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * width), pa.array(np.arange(width, dtype=np.int32)), pa.array(counts)], ["lang", "at", "n"])

    if (n := rows.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MOST_LANGUAGES} can be learned")
    sums = rows.mapInArrow(count, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in sums})
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.int8), np.zeros((width, 1), np.float32), np.ones(1))
    counts = np.zeros((len(languages), width))
    place = {name: i for i, name in enumerate(languages)}
    for r in sums:
        counts[place[r["lang"]], r["at"]] = r["n"]
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    side = lambda s: np.stack([shares[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.full(width, 1 / width) for b in range(code.shape[1])], 1)
    model = LanguageModel(languages, code, np.log(side(1) / side(-1)).astype(np.float32), np.ones(code.shape[1]))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, seen = np.zeros(code.shape[1]), 0
        for batch in batches:
            bits = code[[place[x] for x in batch.column(0).to_pylist()]]
            for first, end, data, offsets in slices(batch.column(1)):
                good += (model.margins(data, offsets) * bits[first:end] > 0).sum(0)
                seen += end - first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(good), dtype=np.int32)), pa.array(good), pa.array(np.full(len(good), float(seen)))], ["bit", "good", "seen"])

    measured = {r["bit"]: r["good"] / max(r["seen"], 1) for r in rows.mapInArrow(right, "bit int, good double, seen double").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).collect()}
    reliable = np.array([max(measured.get(b, 0.5) - 0.5, 0.01) for b in range(code.shape[1])])
    model.reliable = reliable / reliable.mean()
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score (0 to 1) and ambiguous; one row for each row of docs."""
    n = len(keep)
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text).alias("_text"))
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, near = np.full(len(batch), len(names) - 1), np.zeros(len(batch)), np.zeros(len(batch), bool)
            known = batch.column(n).to_numpy(zero_copy_only=False) if model.languages else np.zeros(len(batch), bool)
            if known.any():
                for first, end, data, offsets in slices(batch.column(n + 1)):
                    shares = model.decode(model.margins(data, offsets))
                    best[first:end], score[first:end] = shares.argmax(1), shares.max(1)
                    if shares.shape[1] > 1:
                        near[first:end] = np.partition(shares, -2, 1)[:, -2] >= NEAR * score[first:end]
                best, score, near = np.where(known, best, len(names) - 1), np.where(known, score, 0.0), near & known
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names[best], pa.string()), pa.array(score), pa.array(near)], [*batch.schema.names[:n], "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"_keep{i} {rows.schema[i].dataType.simpleString()}" for i in range(n))
    out = rows.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean")
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep) if c not in ("lang_pred", "score", "ambiguous")], "lang_pred", "score", "ambiguous")
