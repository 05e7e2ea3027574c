"""From raw documents to training tokens, in five stages; each one's output is a Parquet table that the next reads.

Every stage but the last returns the columns of documents. Edge cases are those of the operators; here besides: rows
without a doc_id are linked with nothing and stay, and rows of one doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontamination, jaccard, quality, substring_dedup
from cairn.llm.common import Tables, passing, prepare, table, without, written

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those with a rating, doesn't reject."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("tail_probability") >= quality.KEPT_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that of the smallest doc_id."""
    prepare(spark)
    kept = Tables(spark, "others")
    with passing(spark):
        members = jaccard.join(docs)
        others = kept.write(members.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "others")
    return without(docs, "doc_id", others, others.count())


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated runs, n_chars to match; those of which nothing is left go."""
    prepare(spark)
    cut = substring_dedup.dedup_spans(docs).where("n_removed = 0 or text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    kept = Tables(spark, "leaks")
    with passing(spark):
        found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
        leaks = kept.write(found.where("n_hit > 0").select(F.col("doc").alias("gone")).distinct(), "leaks")
    return without(docs, "doc_id", leaks, leaks.count())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, how many those are, and whether they decode to the text."""
    prepare(spark)
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), outputs=("ids", "n_tokens", "exact"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The first stage is a fitted model, so SQL can't express the result; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
