"""Queries of the operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontamination, jaccard, language_id, pipeline, quality, substring_dedup, token_counts, toxicity, warc, webp
from cairn.llm.common import prepare, remainder, scratch, table, written

BYTE_BPE = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(BYTE_BPE), token_counts.new_cache(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archive")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType
    return warc.read_records(spark, folder, payload=False).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    # a row without a doc_id is in no fold, so it isn't learned from
    model = language_id.train(docs.where("not held_out and doc_id is not null"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.dedup_spans(docs)
    return cut.select("doc_id", "text", "n_removed")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= quality.KEPT_FROM).alias("kept"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.s, g.n, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.n = win.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(len(w), 5) - 1), ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.c + ny.c - i)),
ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, ways.y FROM reach r JOIN ways ON r.b = ways.x),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, comp.c AS component_id
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id JOIN comp ON comp.a = dw.doc_id
"""


def op9_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(webp.store(table(spark, sf_dir, "documents")), "media")
    return webp.read(stored).select(
        "doc_id", "n_bytes", "payload_bytes",
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    model = toxicity.train(docs.where("not held_out and doc_id is not null"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def _prepared(query: Callable) -> Callable:
    """The query, run with the session's SETTINGS."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    query.__name__: _prepared(query)
    for query in (
        op1_token_counts, op2_language_id, op3_warc_archive, op4_bpe_codec, op5_substring_dedup,
        op6_quality, op7_decontamination, op8_ngram_jaccard, op9_media_webp, op10_toxicity,
    )
} | {"pipeline": _prepared(pipeline.run)}
ORACLES: dict[str, str] = {
    "op3_warc_archive": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_ngram_jaccard": OP8_SQL,
}
