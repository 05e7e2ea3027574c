"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a written table of postings (doc, term, position) of the training documents for the terms that the
benchmark uses; a sentinel term whose position is the document's word count closes each document. An item's word at
offset o that stands at position p of a document puts the item on the diagonal p - o. For each window of an item the
rarest terms are looked up: only diagonals in the offset-adjusted lists of all its RAREST rarest terms can hold the
window. Those few diagonals are then compared word by word, which gives the exact windows, wherever they stand.

The terms and anchors follow the benchmark, not the corpus; they are broadcast while they number at most
BROADCAST_ROWS, and joined by shuffling beyond that. Lists are pre-aggregated by (doc, item, diagonal), so a passage
or word that a third of all documents have spreads over the documents that have it.

Edge cases: null and empty texts have no words; an item without words has no window, one of fewer words than a window
is a window by itself; repeated rows of documents are kept and rows with the same key are taken as the same document;
null keys count as one key; repeated item rows count once, and items are told apart by id and words; empty tables give
no hits; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import asked, written

#: Characters that end words: ASCII but for digits and, after lower-casing A-Z, letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Terms of a window whose lists are intersected.
RAREST = 3
#: Benchmark terms or anchors up to this many rows (of under 100 bytes) are broadcast.
BROADCAST_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLOSE = " "  # the sentinel; no word has a space


def words(text: str) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(folded, SEPARATORS), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_words(items: DataFrame, *, text: str = "text", key: str = "item_id") -> DataFrame:
    """item (a number for this run), item_id and its words; items without words are left out."""
    found = items.select(F.col(key).alias("item_id"), words(text).alias("words")).where(F.size("words") > 0).distinct()
    return found.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.array_join("words", " ")))


def build_index(docs: DataFrame, terms: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings (doc, term, position) of the given terms, written once. Term "" is the sentinel: its position is the word count."""
    vocabulary = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(_CLOSE)))
    vocabulary = written(vocabulary.select("term"), "terms")
    all_words = F.concat(words(text), F.array(F.lit(_CLOSE)))
    tokens = docs.select(F.col(key).alias("doc"), F.posexplode(all_words).alias("position", "word"))
    postings = tokens.join(_small(vocabulary, vocabulary.count()), F.col("word") == F.col("term"))
    return written(postings.select("doc", F.when(F.col("term") == _CLOSE, "").otherwise(F.col("term")).alias("term"), "position"), "postings")


def word_counts(index: DataFrame) -> DataFrame:
    return index.where("term = ''").select("doc", F.col("position").cast("long").alias("n_words"))


def anchors(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, start, offset and term: the RAREST rarest terms of the window from `start`, which are all when it is shorter.

    Windows with a term that no document has are left out.
    """
    placed = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    common = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("frequency"))
    placed = placed.join(_small(common, items.select(F.sum(F.size("words"))).first()[0] or 0), "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - window + 1), F.least(F.col("offset"), F.greatest(F.col("n") - window, F.lit(0))))
    inside = placed.withColumn("start", F.explode(starts))
    of = W.partitionBy("item", "start")
    ranked = inside.withColumn("known", F.count("frequency").over(of)).withColumn("size", F.count("*").over(of)).withColumn("place", F.row_number().over(of.orderBy("frequency", "offset")))
    return ranked.where(f"known = size and place <= {RAREST}").select("item", "start", "offset", "term")


def diagonals(index: DataFrame, chosen: DataFrame, n_anchors: int) -> DataFrame:
    """(doc, item, diagonal) that stand in the offset-adjusted lists of all anchors of a window.

    The anchors met on a diagonal are bits, one for an offset modulo 64; each window asks for its own bits.
    """
    bit = F.expr("shiftleft(1L, offset % 64)")
    asked = chosen.groupBy("item", "start").agg(F.bit_or(bit).alias("mask")).groupBy("item").agg(F.collect_set("mask").alias("masks"))
    terms = chosen.select("item", "offset", "term").distinct()
    lists = index.join(_small(terms, n_anchors), "term").select("doc", "item", (F.col("position") - F.col("offset")).alias("diagonal"), bit.alias("bit"))
    met = lists.groupBy("doc", "item", "diagonal").agg(F.bit_or("bit").alias("bits"))
    whole = met.join(_small(asked, n_anchors), "item").where(F.exists("masks", lambda mask: F.col("bits").bitwiseAND(mask) == mask))
    return whole.select("doc", "item", "diagonal")


def phrase_matches(docs: DataFrame, found: DataFrame, items: DataFrame, window: int = WINDOW, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, item_id and spans (array of begin, end in words): the exact occurrences of windows on the diagonals found."""
    lines = found.join(items, "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "diagonal", F.col("words").alias("asked"))).alias("lines"))
    # Few documents have a diagonal; only their texts are to be moved.
    some, count = found.select(F.col("doc").alias("_some")).distinct(), found.count()
    rows = asked(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), F.xxhash64("_key"), some, F.xxhash64("_some"), count)
    rows = rows.join(_small(some, count), F.col("_key").eqNullSafe(F.col("_some")), "left_semi")
    rows = rows.join(lines, F.col("_key").eqNullSafe(F.col("doc")))
    # The size beside the words keeps the optimizer from splitting the text anew for every word compared.
    rows = rows.select("doc", words("_text").alias("own"), "lines").select("doc", "own", F.size("own").alias("n"), "lines")

    def spans(line: Column) -> Column:
        asked, diagonal = line["asked"], line["diagonal"]
        same = F.transform(asked, lambda word, o: F.coalesce(F.get("own", diagonal + o) == word, F.lit(False)))
        # How far the words up to each agree; a window ends where that reaches its size.
        run = lambda acc, ok: F.concat(acc, F.array(F.when(ok, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1).otherwise(0)))
        runs = F.aggregate(same, F.array().cast("array<int>"), run)
        size = F.least(F.size(asked), F.lit(window))
        ends = F.filter(F.transform(runs, lambda n, o: F.when(n >= size, o + 1)), lambda end: end.isNotNull())
        return F.struct(line["item_id"].alias("item_id"), F.transform(ends, lambda end: F.struct((diagonal + end - size).alias("begin"), (diagonal + end).alias("end"))).alias("spans"))

    found = rows.where("n > 0").select("doc", F.explode(F.filter(F.transform("lines", spans), lambda m: F.size(m["spans"]) > 0)).alias("m"))
    return found.select("doc", "m.item_id", "m.spans")


def covered(spans: Column) -> Column:
    """Words inside the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, n_words, n_hit, n_items, items (ids, sorted as texts) and spans (sorted); one row for each row of docs."""
    items = written(item_words(benchmark), "items")
    index = build_index(docs, items.select(F.explode("words").alias("term")), text=text, key=key)
    chosen = written(anchors(index, items, window), "anchors")
    found = written(diagonals(index, chosen, chosen.count()), "diagonals")
    matches = phrase_matches(docs, found, items, window, text=text, key=key)
    hits = matches.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = hits.select(F.col("doc").alias("of"), "items", covered(F.col("spans")).alias("n_hit"), F.array_sort("spans").alias("spans"))
    none = F.array().cast("array<string>")
    return word_counts(index).join(hits, F.col("doc").eqNullSafe(F.col("of")), "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans",
    )


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """doc, item_id and end: places of documents where all distinct terms of an item stand within so many words.

    A place is the position of the last term of such a stretch; every posting of an item's term is looked up. Windows
    are per (doc, item) and so bounded by a document.
    """
    terms = items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("term"), F.size(F.array_distinct("words")).alias("asked"))
    lists = index.join(terms, "term").select("doc", "item", "item_id", "asked", "term", "position")
    behind = W.partitionBy("doc", "item").orderBy("position").rangeBetween(-(within - 1), 0)
    return lists.withColumn("near", F.size(F.collect_set("term").over(behind))).where("near = asked").select("doc", "item_id", F.col("position").alias("end")).distinct()
