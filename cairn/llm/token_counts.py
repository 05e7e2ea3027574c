"""Token counts through a digest cache.

Each text has a content digest (SHA-256 of its UTF-8 bytes after normalisation: null becomes empty), each tokenizer
file a version digest. The cache is a Parquet table (tokenizer, digest, n_tokens). Documents join it on both digests;
only one text per digest that the cache lacks is encoded, and those counts are appended.

Shuffles: narrow rows (digest, key) pre-aggregated by digest, then the texts of misses by (digest, key), which is a
unique pair and so never hot. With a warm cache the misses are few and Spark broadcasts them instead. Copies of one
text meet only as narrow rows of a plain join that adaptive execution can split.

Edge cases: null and empty texts count 0 tokens; repeated rows and null keys are kept, one output row for each input
row; an empty table gives an empty result; columns of the input not named in `keep` are ignored, and kept ones with
an output's name are replaced; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import scratch, utf8_bytes, written

#: The split pattern of the byte-level pre-tokenizer. Fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = "tokenizer string, digest binary, n_tokens long"
_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE whose ids are its merge order, with the usual pattern and plain added tokens."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges")
        and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


def _merge_order_is_id_order(spec: dict) -> bool:
    vocab = spec["model"]["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    last = -1
    for a, b in pairs:
        if (now := vocab[a + b]) <= last:
            return False
        last = now
    return True


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, kept for the life of a worker process.

    A plain byte-level file is encoded with tiktoken from the file's own vocabulary, which gives the tokenizers
    library's ids several times faster; a text that it can't take goes to the tokenizers library, as do other files.
    """
    if path in _counters:
        return _counters[path]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    else:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        whole = lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if is_plain_byte_level(spec) and _merge_order_is_id_order(spec):
            import tiktoken

            alphabet, added = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)

            def count(texts: list[str]) -> list[int]:
                out = []
                for text in texts:
                    try:
                        out.append(len(fast.encode(text, allowed_special="all")))
                    except (KeyboardInterrupt, SystemExit):
                        raise
                    except BaseException:  # noqa: BLE001  its engine gives up on some very long runs
                        out += whole([text])
                return out
        else:
            count = whole
    _counters[path] = count
    return count


def tokenizer_version(path: str) -> str:
    """SHA-256 of a tokenizer's file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def cached(spark, cache: str) -> DataFrame:
    """The cache table; empty if nothing has been written yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.lit("").alias("tokenizer"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, n_bytes, content_digest (binary) and n_tokens; one row for each row of docs.

    `cache` is a folder that all executors reach; texts it doesn't know under this tokenizer's version are encoded and
    appended before this returns. `key` only spreads the texts of misses; it need not be unique.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], utf8_bytes(text).alias("_bytes"), digest.alias("_digest"))
    known = cached(spark, cache).where(F.col("tokenizer") == version).select("digest", F.lit(True).alias("known"))
    one = docs.select(digest.alias("digest"), F.col(key).alias("_key")).groupBy("digest").agg(F.min("_key").alias("one"))
    one = written(one, "digests")
    missing = one.join(known, "digest", "left").where("known is null").select(F.col("digest").alias("_want"), "one")
    bodies = docs.select(digest.alias("digest"), F.col(key).alias("_key"), body.alias("body"))
    misses = bodies.join(missing, (F.col("digest") == F.col("_want")) & F.col("_key").eqNullSafe(F.col("one"))).select("digest", "body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    fresh = misses.mapInArrow(encode, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Of the cache this run's digests go on. Two runs may have appended the same one, so counts are made unique.
    stored = cached(spark, cache).where(F.col("tokenizer") == version).join(one, "digest", "left_semi")
    counts = written(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, F.col("_digest") == F.col("digest"), "left").select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep) if c not in ("n_bytes", "content_digest", "n_tokens")], F.col("_bytes").alias("n_bytes"), F.col("_digest").alias("content_digest"), "n_tokens"
    )


def new_cache(spark) -> str:
    """A cache folder for one run, in the shared scratch folder."""
    return scratch(spark, "token-cache")
