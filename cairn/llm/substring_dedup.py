"""Substring dedup by sliding spans of sentences, then by spans of words for passages without enough whole sentences.

Every run of `run` consecutive sentences of a document, of `least_words` words or more, is hashed (sentences compare by
their words, A-Z lower-cased, so spacing and punctuation between words don't matter). Runs are joined by hash over all
documents. The first of equal runs, by (key, place), stays; the sentences of any other are removed.

What that leaves is cut again by spans of SPAN words, wherever sentences begin and end. Of each WINDOW spans in a row the
one of the least hash is taken, so two equal stretches of SPAN + WINDOW - 1 = 49 words or more have a taken span in
common, at the same place of the stretch; what stays of a longer one is at most 24 words at either end. Of equal
spans the first stays here too. Within a document a span that overlaps its own copy (text of a short period) isn't one.

Repeats within a document are known where it is read. For the others two shuffles move the spans as narrow rows: one
finds each hash's first document, pre-aggregated, so that a passage in a third of all documents is a row per task; the
other joins the repeated hashes back, a plain join that adaptive execution can split. Then documents join their own
places on (key, content). A broadcast bitmap keeps from the second shuffle nearly all spans that aren't repeated, and from
the third nearly all documents without places. Both cuts do this; only texts that the first may change are written between.

Edge cases: null and empty texts have no runs and stay as they are; a text of fewer sentences than a run and of fewer
than 49 words is never changed; words are separated by ASCII alone, so scripts without spaces are cut by sentences only;
rows of equal key are one document: runs that they share stay in both, so repeated rows are treated alike;
null keys are one document, the last; all columns of the input are kept and those with the outputs' names replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Sketch, Tables, passing, sifted, sketch, with_column, with_field, written
from cairn.llm.textkernel import NOT_ALNUM, chained, mix, rolled, slices, words

#: Sentences of a run, and the least words in it.
RUN, LEAST_WORDS = 3, 10
#: Words of a span, and of how many spans in a row one is taken; a text's words number fewer than 2^PLACE_BITS.
SPAN, WINDOW, PLACE_BITS = 25, 25, 30
_LINE = np.isin(np.arange(256), [10, 13])
_STOP = np.isin(np.arange(256), [33, 46, 63])  # ! . ?
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, first word, end word) of each sentence with words, and the hashes of words: a sentence begins after
    a line end, or after white space that follows ! . or ?"""
    hashed, starts, _, _ = words(data, offsets, NOT_ALNUM)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, hashed
    stops = np.flatnonzero(_STOP[data[:-1]] & _BLANK[data[1:]]) + 1
    cuts = np.union1d(np.union1d(np.flatnonzero(_LINE[data]), stops), offsets)
    part = np.searchsorted(cuts, starts, "right")
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    text = np.searchsorted(offsets, starts[first], "right") - 1
    return text, cuts[part[first] - 1], first, hashed


def sentence_hashes(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each sentence's words in order, and how many there are."""
    count = np.diff(np.append(first, len(hashed)))
    place = np.arange(len(hashed)) - np.repeat(first, count)
    parts = mix(hashed + mix(place.astype(np.uint64)))  # a word at its place
    return mix(np.add.reduceat(parts, first) + count.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64), count


def _runs(batch_text: pa.Array, run: int, least_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first sentence, hash, whether the row has it before) of each run, by slice."""
    for start, _, data, offsets in slices(batch_text):
        text, _, first, hashed = sentences(data, offsets)
        own, count = sentence_hashes(hashed, first)
        n = len(own) - run + 1
        if n <= 0:
            continue
        total = np.concatenate([[0], np.cumsum(count)])
        good = (text[:n] == text[run - 1 :]) & (total[run:] - total[:n] >= least_words)
        number = np.arange(len(text)) - np.searchsorted(text, text)  # of a sentence within its text
        row, at, value = text[:n][good] + start, number[:n][good], chained(own, run)[good]
        order = np.lexsort((at, value, row))
        again = np.zeros(len(row), bool)
        again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
        yield row, at, value, again


def taken(hashed: np.ndarray, bounds: np.ndarray, span: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the spans taken: of each `window` spans in a row of one text the least hash, the last of equals."""
    value = rolled(hashed, span)
    count = np.maximum(np.diff(bounds) - span + 1, 0)  # spans of each text
    ends = np.cumsum(count)
    first = np.arange(count.sum()) + np.repeat(bounds[:-1] - (ends - count), count)
    value = value[first]
    if len(value) < window:
        return first[:0], value[:0]
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (value & ~low) | (low - np.arange(len(value), dtype=np.uint64))
    width = 1
    while width < window:  # the least of ever wider windows
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    of_text = np.repeat(np.arange(len(count)), count)
    at = (low - (least & low)).astype(np.int64)[of_text[: len(least)] == of_text[window - 1 :]]
    at = at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))] if len(at) else at
    return first[at], value[at]


def _spans(batch_text: pa.Array, span: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first word, hash, whether the row has it before without overlap) of each span taken, by slice."""
    for start, _, data, offsets in slices(batch_text):
        hashed, _, _, bounds = words(data, offsets, NOT_ALNUM)
        first, value = taken(hashed, bounds, span, window)
        if not len(first):
            continue
        row = np.searchsorted(bounds, first, "right") - 1
        at = first - bounds[row]
        order = np.lexsort((at, value, row))
        r, v, a = row[order], value[order], at[order]
        same = np.concatenate([[False], (r[1:] == r[:-1]) & (v[1:] == v[:-1])])
        apart = np.cumsum(same & (np.diff(a, prepend=0) >= span))  # copies that overlap are of one chain
        begun = np.flatnonzero(~same)
        again = np.zeros(len(row), bool)
        again[order] = apart > np.repeat(apart[begun], np.diff(np.append(begun, len(r))))
        yield row + start, at, value, again


def _hashed(docs: DataFrame, find: Callable) -> DataFrame:
    """key, content, at, run, again: what `find` gives of each text; docs has key, content, text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, value, again in find(batch.column(2)):
                take = pa.array(row)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "content", "at", "run", "again"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "content", "text").mapInArrow(make, f"key {kind}, content long, at int, run long, again boolean")


def runs(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, content, at, run, again: the hash of every run of sentences, by its first sentence `at`; docs has key, content, text."""
    return _hashed(docs, lambda column: _runs(column, run, least_words))


def _cut(text: str, places: list[int], run: int) -> tuple[str, int]:
    """The text without the sentences of the runs that begin at the given sentences, and how many those are."""
    raw = text.encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    _, begins, _, _ = sentences(data, offsets)
    gone = np.zeros(len(begins), bool)
    for k in range(run):
        gone[np.minimum(np.array(places) + k, len(begins) - 1)] = True
    ends = np.append(begins[1:], len(raw))
    kept = [raw[: begins[0]]] + [raw[b:e] for b, e, g in zip(begins, ends, gone, strict=True) if not g]
    return b"".join(kept).decode().strip(), int(gone.sum())


def _cut_words(text: str, places: list[int], span: int) -> tuple[str, int]:
    """The text without the words of the spans that begin at the given words, and how many sentences lose words. A
    sentence that loses all goes as a whole; another keeps what stands before its first word."""
    raw = text.encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    _, begins, first, _ = sentences(data, offsets)
    _, starts, _, _ = words(data, offsets, NOT_ALNUM)
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, np.array(places), 1)
    np.add.at(gone, np.minimum(np.array(places) + span, len(starts)), -1)
    gone = np.cumsum(gone[:-1]) > 0
    ends = np.append(starts[1:], len(raw))  # of a word with what follows it, as far as its sentence goes
    ends[first[1:] - 1] = begins[1:]
    whole = np.logical_and.reduceat(gone, first)
    kept = np.ones(len(raw), bool)
    for b, e in zip(starts[gone], ends[gone], strict=True):
        kept[b:e] = False
    for b, e in zip(begins[whole], np.append(begins[1:], len(raw))[whole], strict=True):
        kept[b:e] = False
    return data[kept].tobytes().decode().strip(), int(np.logical_or.reduceat(gone, first).sum())


def _places(docs: DataFrame, find: Callable, text: str, key: str, kept: Tables, name: str) -> tuple[DataFrame, Sketch]:
    """key, content and places (at), in `kept`, of the texts of which `find` hashes what an earlier place has; and the sketch of those texts."""
    all_runs = _hashed(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("content"), F.col(text).alias("text")), find)
    with passing(docs.sparkSession):
        firsts = all_runs.where("not again").groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("key").alias("keys"), F.count("*").alias("n"))
        repeated = written(firsts.where("first <> last or (keys between 1 and n - 1)").select(F.col("run").alias("of"), "first"), "repeated")
        some, _ = sifted(all_runs, F.col("run"), sketch(repeated, F.col("of"), repeated.count()), also=F.col("again"))
        others = some.join(repeated, F.col("run") == F.col("of"), "left").where("again or (of is not null and not (key <=> first))")
        places = kept.write(others.groupBy("key", "content").agg(F.collect_set("at").alias("places")), f"places-{name}")
    seen = sketch(places, F.xxhash64("key", "content"), places.count())
    return places, seen._replace(slots=kept.write(seen.slots, f"sketch-{name}"))


def _cut_at(docs: DataFrame, places: DataFrame, seen: Sketch, cut: Callable[[str, list[int]], tuple[str, int]], text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """docs whose text has no places, as they are, and the others, with few besides, cut; the sentences cut are added to n_removed."""
    content = F.xxhash64(F.col(text))
    of_key, of_content, found_at = (f"{'_' * (1 + max(map(len, docs.columns)))}{name}" for name in ("key", "content", "places"))  # longer than any name of docs
    some, rest = sifted(docs, F.xxhash64(F.col(key), content), seen)
    places = places.withColumnsRenamed({"key": of_key, "content": of_content, "places": found_at})
    marked = some.join(places, F.col(key).eqNullSafe(F.col(of_key)) & (content == F.col(of_content)), "left").drop(of_key, of_content)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, removed = batch.column(found_at).to_pylist(), batch.column(text), batch.column("n_removed").to_pylist()
            if any(found):
                new = texts.to_pylist()
                for i, at in enumerate(found):
                    if at:
                        new[i], n = cut(new[i], at)
                        removed[i] += n
                texts = pa.array(new, pa.string())
            names = [c for c in batch.schema.names if c != found_at]
            whole = pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in names], names)
            yield with_column(whole, "n_removed", pa.array(removed, pa.int64()))

    return rest, marked.mapInArrow(rewrite, with_field(docs, "n_removed", T.LongType()))


def dedup_spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with its text cut, and n_removed, the number of sentences removed from it or shortened."""
    docs = docs.drop("n_removed").withColumn("n_removed", F.lit(0).cast("long"))
    kept = Tables(docs.sparkSession, "cut")
    places, seen = _places(docs, lambda c: _runs(c, run, least_words), text, key, kept, "sentences")
    rest, cut = _cut_at(docs, places, seen, lambda t, at: _cut(t, at, run), text, key)
    left = rest.unionByName(kept.write(cut, "texts"))
    kept.drop("places-sentences")
    places, seen = _places(left, lambda c: _spans(c, SPAN, WINDOW), text, key, kept, "words")
    rest, cut = _cut_at(left, places, seen, lambda t, at: _cut_words(t, at, SPAN), text, key)
    return rest.unionByName(cut)
