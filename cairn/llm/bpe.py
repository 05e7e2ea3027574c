"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece of text starts as its bytes. Leaf i of the tree holds (rank of the pair at i, i), an inner node the least of
its children, so the root is the leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic time,
and merging ends when no leaf holds a rank. Short pieces have their trees side by side as rows of an array, so that a
numpy step merges a pair in each of them (`merge_all`); a long piece has a tree of its own (`merge`). Of the pieces of a
batch only the distinct ones are merged that a bounded memo doesn't have; ids and decoded bytes are gathered by index.

Every document is encoded where it is read: no shuffle, no state between tasks. `round_trip` encodes, decodes and
digests in one Python step.

Edge cases: null and empty texts have no ids and decode to the empty text (null ids decode to empty too); added
tokens' strings inside a text become their ids; pieces of any length are encoded whole; all columns of the input are
kept, and a column with the output's name is replaced; bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import with_column, with_field
from cairn.llm.token_counts import BYTE_LEVEL_PATTERN, byte_alphabet, is_plain_byte_level

#: Pieces of a memo, about 200 bytes each, before those that the present batch doesn't have are dropped.
MEMO = 120_000
#: Bytes of the longest piece whose tree is a row among others, and leaves of the trees merged together.
SHORT, LEAVES = 64, 1 << 16
#: Code points on which every Unicode version agrees about letters, digits and white space, as ends of ranges; texts
#: with others are split by the library.
SETTLED = ((0, 0x530), (0x2000, 0x2080))
_NONE = 1 << 62


def merge(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """BPE of one piece. ranks: of pair (a, b) under a << 20 | b; merged: the id that each rank makes."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length()
    rank_of = ranks.get
    tree = [_NONE] * (2 * size)
    node, a = size, ids[0]
    for b in ids[1:]:
        rank = rank_of(a << 20 | b)
        if rank is not None:
            tree[node] = rank * n + node - size
        node, a = node + 1, b
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := tree[1]) != _NONE:
        rank, at = divmod(least, n)
        ids[at] = new = merged[rank]
        gone = after[at]
        after[at] = following = after[gone]
        changes = [(size + gone, _NONE)] if gone < n - 1 else []
        if following < n:
            before[following] = at
            rank = rank_of(new << 20 | ids[following])
            changes.append((size + at, _NONE if rank is None else rank * n + at))
        else:
            changes.append((size + at, _NONE))
        if (prev := before[at]) >= 0:
            rank = rank_of(ids[prev] << 20 | new)
            changes.append((size + prev, _NONE if rank is None else rank * n + prev))
        for node, value in changes:
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


class Ranks:
    """Ranks of pairs (a, b) by a << 20 | b, for whole arrays."""

    def __init__(self, ranks: dict[int, int]):
        self.keys = np.array(sorted(ranks), np.int64)
        self.values = np.array([ranks[k] for k in self.keys.tolist()], np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where a pair has none."""
        asked = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.values[at], -1)


def merge_all(ids: np.ndarray, n: np.ndarray, size: int, ranks: Ranks, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BPE of pieces of 2 to size + 1 symbols, end to end in ids, n symbols each; size is a power of 2. Returns the same of the results."""
    count = len(n)
    column = np.arange(size + 2)
    inside = column < n[:, None]
    symbol = np.zeros((count, size + 2), np.int64)
    symbol[inside] = ids
    leaf = lambda rank, place: np.where(rank < 0, _NONE, rank * size + place)
    tree = np.full((count, 2 * size), _NONE)
    pair = inside[:, 1 : size + 1]
    tree[:, size:][pair] = leaf(ranks.of(symbol[:, :size][pair], symbol[:, 1 : size + 1][pair]), np.broadcast_to(column[:size], pair.shape)[pair])
    width = size
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2
    after, before = np.tile(column + 1, (count, 1)), np.tile(column - 1, (count, 1))
    alive = inside.copy()
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], size)
        new = merged[rank]
        gone = after[rows, at]
        following, previous = after[rows, gone], before[rows, at]
        symbol[rows, at] = new
        alive[rows, gone] = False
        after[rows, at] = following
        before[rows, following] = at
        last, first = following >= n[rows], previous < 0
        right = np.where(last, _NONE, leaf(ranks.of(new, symbol[rows, following]), at))
        left = np.where(first, _NONE, leaf(ranks.of(symbol[rows, previous], new), previous))
        # the leaf of the symbol that is gone, if it has one, then those of the pairs on both sides
        some, held = np.flatnonzero(gone < size), np.flatnonzero(~first)
        row = np.concatenate([rows[some], rows, rows[held]])
        node = np.concatenate([gone[some], at, previous[held]]) + size
        tree[row, node] = np.concatenate([np.full(len(some), _NONE), right, left[held]])
        for _ in range(size.bit_length() - 1):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        rows = rows[tree[rows, 1] != _NONE]
    return symbol[alive], alive.sum(1)


class Strings:
    """A table of byte strings whose entries are put end to end by number."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings' bytes, and where each begins; the end too."""
        sizes = self.sizes[numbers]
        ends = np.append(0, np.cumsum(sizes))
        return self.data[np.arange(ends[-1]) + np.repeat(self.starts[numbers] - ends[:-1], sizes)].tobytes(), ends


class ByteBpe:
    """A tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not is_plain_byte_level(spec):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.ranked = Ranks(self.ranks) if self.ranks else None
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.of_byte[byte] = vocab[char]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.unsettled, self.pattern = settled_patterns()
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        # a piece never holds an added token's string, as texts are split at those first
        self.fixed = {token: np.int32(i).tobytes() for token, i in self.added.items()}
        self.memo = dict(self.fixed)
        named = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items() if token not in self.added} | {i: token.encode() for token, i in self.added.items()}
        self.text_of = Strings([named.get(i, b"") for i in range(max(named) + 1)])
        self.digits_of = Strings([b"%d," % i for i in range(max(named) + 1)])

    def merge_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        raw = [x.encode() for x in pieces]
        sizes = np.array([len(x) for x in raw], np.int64)
        leaves = np.where((sizes < 2) | (sizes > SHORT), 0, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64))
        for size in np.unique(leaves).tolist():
            at = np.flatnonzero(leaves == size).tolist()
            if not size or self.ranked is None:
                for i in at:
                    found = self.of_byte[np.frombuffer(raw[i], np.uint8)].tolist()
                    out[i] = np.array(merge(found, self.ranks, self.merged), np.int32).tobytes()
                continue
            for some in (at[k : k + LEAVES // size] for k in range(0, len(at), LEAVES // size)):
                symbols = self.of_byte[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                ids, n = merge_all(symbols, sizes[some], size, self.ranked, self.merged)
                packed, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(n)).tolist()
                for i, a, b in zip(some, [0, *ends], ends, strict=False):
                    out[i] = packed[a:b]
        return out

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Pieces and added tokens."""
        if self.specials is None or not any(token in text for token in self.added):
            return self.pieces(text)
        out = []
        for part in self.specials.split(text):
            out += [part] if part in self.added else self.pieces(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and where each text's begin; the end too."""
        split = [self.split(x) if x else [] for x in texts]
        asked = set().union(*split)
        missing = [x for x in asked if x not in self.memo]
        if len(self.memo) + len(missing) > MEMO:
            self.memo = self.fixed | {x: self.memo[x] for x in asked if x in self.memo}
        self.memo.update(zip(missing, self.merge_pieces(missing), strict=True))
        coded = [b"".join(map(self.memo.__getitem__, x)) for x in split]
        return np.frombuffer(b"".join(coded), np.int32), np.append(0, np.cumsum([len(x) // 4 for x in coded], dtype=np.int64))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts in UTF-8, added tokens included."""
        raw, ends = self.text_of.gather(ids)
        out = [raw[a:b] for a, b in zip(ends[starts[:-1]].tolist(), ends[starts[1:]].tolist(), strict=True)]
        try:
            raw.decode()
            return out
        except UnicodeDecodeError:
            return [x.decode("utf-8", "replace").encode() for x in out]

    def digests(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """SHA-256 of each text's ids in decimal, joined by commas."""
        raw, ends = self.digits_of.gather(ids)
        return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[starts[:-1]].tolist(), ends[starts[1:]].tolist(), strict=True)]


def _ranges(kind: str) -> str:
    """The settled characters of a kind, as inside of a character class."""
    test = regex.compile(kind)
    return "".join(f"\\u{c:04x}" for a, b in SETTLED for c in range(a, b) if test.match(chr(c)))


@lru_cache(maxsize=1)
def settled_patterns() -> tuple[re.Pattern, re.Pattern]:
    """A character that isn't settled, and the split pattern for settled texts, spelled out for the faster engine."""
    letter, digit, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    spelled = BYTE_LEVEL_PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in SETTLED) + "]"), re.compile(spelled)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))


#: What round_trip can give of a text: Spark's type, and the column of (tokenizer, texts, ids, starts, decoded texts).
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), lambda bpe, texts, ids, starts, decoded: _lists(ids, starts)),
    "n_tokens": (T.LongType(), lambda bpe, texts, ids, starts, decoded: pa.array(np.diff(starts))),
    "ids_sha256": (T.StringType(), lambda bpe, texts, ids, starts, decoded: pa.array(bpe.digests(ids, starts), pa.string())),
    "decoded": (T.StringType(), lambda bpe, texts, ids, starts, decoded: pa.array(decoded, pa.binary()).cast(pa.string())),
    "decoded_sha256": (T.StringType(), lambda bpe, texts, ids, starts, decoded: pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())),
    "exact": (T.BooleanType(), lambda bpe, texts, ids, starts, decoded: pa.array([x == (y or "").encode() for x, y in zip(decoded, texts, strict=True)], pa.bool_())),
}


def round_trip(df: DataFrame, tokenizer: str, *, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """df with the named OUTPUTS as columns: texts are encoded and the ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids, starts = bpe.encode(texts)
            decoded = bpe.decode(ids, starts)
            for name in outputs:
                batch = with_column(batch, name, OUTPUTS[name][1](bpe, texts, ids, starts, decoded))
            yield batch

    schema = T.StructType([f for f in df.schema.fields if f.name not in outputs] + [T.StructField(name, OUTPUTS[name][0]) for name in outputs])
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column `ids`, array<int>: the ids of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            yield with_column(batch, ids, _lists(*bpe.encode(batch.column(text).to_pylist())))

    return df.mapInArrow(run, with_field(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, tokenizer: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column `decoded`: the text of `ids`. An id that the tokenizer doesn't have is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            lists = batch.column(ids)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            found = lists.flatten().fill_null(-1).to_numpy().astype(np.int64)
            if len(found) and (found.min() < 0 or found.max() >= len(bpe.text_of.sizes)):
                raise ValueError("an id isn't in the vocabulary")
            decoded = bpe.decode(found, np.append(0, np.cumsum(sizes, dtype=np.int64)))
            yield with_column(batch, text, pa.array(decoded, pa.binary()).cast(pa.string()))

    return df.mapInArrow(run, with_field(df, text, T.StringType()))
