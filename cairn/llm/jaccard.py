"""Exact similarity join of word shingles by Jaccard similarity, through a token-group matrix.

Two texts link when their shingle sets have a similarity of at least 4/5. The result names each text's component of
links. Equal sets are one class, whatever their number, and only one text of a class goes on.

1. Filter. With tokens in hash order, two linked sets of n and n' tokens share the first t of their common tokens
   within the first n // 5 + t tokens of each. So a set most of whose first quarter of tokens occurs in no other set's
   first quarter links with nothing. Tokens travel packed: a block of sets sends each bucket of hashes its tokens, with
   the set of each, and gets back how many of a set's tokens another set has too.
2. Groups. The sets left are sorted by min-hashes and cut into groups of at most GROUP; each group's pairs are compared
   in one task. The best linked set of a group is compared with the next group too while the min-hash stays the same, so
   a long run of near copies becomes one component. Each component is contracted to its best linked set, and that and a
   few others are grouped again by other min-hashes: two central sets of a cluster's pieces needn't link though others
   do. A round gathers of a large cluster all whose min-hash is the commonest there, so few pieces are left to meet in
   the matrix.
3. Matrix. Each group's token union has a row (token, group) for every token of two groups or more. A set orders its
   tokens by the number of groups that have them, the rarest first. If x has no fewer tokens than y and links with it,
   their first common token is so early in both that enough tokens follow (`probe`), so few rows are asked for and few
   can answer, and a component that is one already is never asked. A group that holds fewer than 4/5 of a set's tokens
   in its union isn't opened. Queries of a much-asked group are split over tasks.

No bound drops a link: each step either compares two sets or proves that they don't link or are connected already.
Tokens are 64-bit hashes of shingles and are compared as such, not by their words; classes are told apart by 128 bits.

Edge cases: null and empty texts, and those of white space only, have an empty set, linked with nothing; fewer words
than a shingle are one shingle; keys are integers; rows of an equal key are one document with its rows' links
together; a null key has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_KEYS, Tables, asked, within
from cairn.llm.components import connected
from cairn.llm.textkernel import SPACE, chained, mix, slices, words

SHINGLE = 5
#: Sets of a group, and queries of a group that one task compares.
GROUP, QUERIES = 128, 512
#: Rounds of grouping, each by a min-hash of its own and, where that is equal, by the next one, and how many sets of a
#: component go on to the next round.
ROUNDS, SPOKESMEN = 3, 4
#: Tokens of a block and of a bucket of the filter and the matrix, about.
BLOCK, BUCKET = 1 << 19, 500_000
#: Bytes of tokens in a partition of groups, about.
PARTITION = 8 << 20
#: Columns of a block of the incidence matrix.
COLUMNS = 8192
_U = np.uint64


def most_missing(n):
    """Tokens that a linked set of n tokens may lack in the other."""
    return n // 5


def sure(n):
    """Common tokens that the filter's prefix of a linked set of n tokens holds."""
    return n // 12 + 1


def needed(n):
    """Common tokens sure to be in both prefixes, the other set having at least 4/5 of n tokens."""
    return sure((4 * n + 4) // 5)


_NEEDED = "((4 * n + 4) div 5) div 12 + 1"  # needed(), in SQL


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in slices(texts):
        hashed, _, _, bounds = words(data, offsets, SPACE)
        whole = chained(hashed, size)
        for i in range(end - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                yield mix(chained(hashed[a:b], b - a) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def _tokens(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Views of a binary column's values."""
    return [np.frombuffer(x.as_buffer(), _U) if x.is_valid else np.zeros(0, _U) for x in column]


def _of(column, kind) -> np.ndarray:
    """A binary column's values end to end."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind)


def _name(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def sign(docs: DataFrame, *, text: str, key: str) -> DataFrame:
    """key, n, digest of the set, block and row in it, and the packed tokens of the filter's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = held = 0
        for batch in batches:
            ns, digests, blocks, rows, prefixes = [], [], [], [], []
            for own in shingle_sets(batch.column(1)):
                digest = hashlib.blake2b(own.data, digest_size=16).digest()
                if not row or held >= BLOCK:
                    block, row, held = _name(digest + repr((batch.column(0)[len(ns)].as_py(), block)).encode()), 0, 0
                prefix = own[: most_missing(len(own)) + sure(len(own))] if len(own) else own
                ns.append(len(own))
                digests.append(digest)
                blocks.append(block)
                rows.append(row)
                prefixes.append(prefix.tobytes())
                row, held = row + 1, held + len(prefix)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), pa.array(prefixes, pa.binary())], ["key", "n", "digest", "block", "row", "prefix"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n long, digest binary, block long, row int, prefix binary")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return np.append(0, cuts), np.append(cuts, len(ordered))


_SENT = "bucket long, block long, tokens binary, rows binary"


def _deal(block: int, tokens: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """_SENT of a block: its tokens by bucket, each with its row."""
    bucket = (mix(tokens) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, rows = bucket[order], tokens[order], rows[order]
    starts, ends = _runs(bucket)
    parts = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), block)), parts(tokens), parts(rows.astype(np.int32))], ["bucket", "block", "tokens", "rows"])


def _meeting(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(message, row, token, number of its first equal) of a bucket's tokens in the order of tokens; messages in table order."""
    tokens, rows = _of(table.column("tokens"), _U), _of(table.column("rows"), np.int32)
    message = np.repeat(np.arange(table.num_rows, dtype=np.int32), [len(x.as_buffer()) // 8 for x in table.column("tokens")])
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    starts, ends = _runs(tokens)
    return message[order], rows[order], tokens, np.repeat(np.arange(len(starts)), ends - starts)


def _packed(table: pa.Table, message: np.ndarray, name: str, **values: np.ndarray) -> pa.Table:
    """A row for each message that occurs: the column `block` of its row in the table as `name`, and its values, packed."""
    order = np.argsort(message, kind="stable")
    message = message[order]
    starts, ends = _runs(message)
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    columns = {k: v[order] for k, v in values.items()}
    return pa.table({name: table.column("block").take(pa.array(message[starts]))} | {k: pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for k, v in columns.items()})


def candidates(signed: DataFrame, tables: Tables) -> DataFrame:
    """digest of the classes that the filter leaves."""
    total = signed.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(total / 3.5 / BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, int, int]] = []

        def flush() -> pa.RecordBatch:
            name = held[0][0].column("block")[held[0][1]].as_py()
            own, row, digests = [], [], set()
            for batch, a, b in held:
                for i in range(a, b):
                    # a token counts once for each different set of the block
                    if (digest := batch.column("digest")[i].as_py()) not in digests:
                        digests.add(digest)
                        own.append(batch.column("prefix")[i].as_buffer())
                        row.append((batch.column("row")[i].as_py(), len(own[-1]) // 8))
            tokens = np.frombuffer(b"".join(own), _U)
            return _deal(name, tokens, np.repeat([r for r, _ in row], [n for _, n in row]), buckets)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and held and held[0][0].column("block")[held[0][1]].as_py() != blocks[a]:
                    yield flush()
                    held.clear()
                if a < b:
                    held.append((batch, a, b))
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        """Of a bucket: the set of each token that stands in another set too."""
        message, row, _, number = _meeting(table)
        shared = np.bincount(number)[number] > 1
        return _packed(table, message[shared], "block", rows=row[shared])

    def count(table: pa.Table) -> pa.Table:
        """Of a block: how many such tokens each set has."""
        hits = np.bincount(_of(table.column("rows"), np.int32))
        row = np.flatnonzero(hits)
        return pa.table({"block": table.column("block").take(pa.array(np.zeros(len(row), np.int64))), "row": pa.array(row.astype(np.int32)), "hits": pa.array(hits[row])})

    sent = signed.where("n > 0").select("block", "row", "digest", "prefix").mapInArrow(send, _SENT)
    back = sent.groupBy("bucket").applyInArrow(meet, "block long, rows binary")
    met = tables.write(back.groupBy("block").applyInArrow(count, "block long, row int, hits long"), "hits")
    return signed.select("block", "row", "n", "digest").join(met, ["block", "row"]).where(f"hits >= {_NEEDED}").select("digest").distinct()


def set_table(docs: DataFrame, keys: DataFrame, count: int, *, text: str, key: str) -> DataFrame:
    """id, n and packed tokens of the counted keys' texts, with ROUNDS min-hashes (h0, h1, ...) for grouping."""
    hashes = [f"h{seed}" for seed in range(ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            low = [np.array([int(mix(s * _U(2 * seed + 3) + _U(seed)).min()) if len(s) else 0 for s in sets], _U) for seed in range(ROUNDS)]
            keys = [pa.array(mix(x).view(np.int64)) for x in low]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", *hashes, "tokens"])

    rows = asked(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), F.xxhash64("id"), keys, F.xxhash64("id"), count)
    return rows.join(within(keys, count, BROADCAST_KEYS), "id", "left_semi").mapInArrow(run, f"id long, n long, {', '.join(f'{h} long' for h in hashes)}, tokens binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    own = np.concatenate(right) if right else np.zeros(0, _U)
    asked = np.concatenate(left) if left else np.zeros(0, _U)
    if not len(own) or not len(asked):
        return out
    known = np.unique(own)
    known = known[np.isin(known, asked)]
    if not len(known):
        return out

    def place(sets: list[np.ndarray], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(known, tokens)
        met = known[np.minimum(at, len(known) - 1)] == tokens
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[met], at[met]

    (lr, lc), (rr, rc) = place(left, asked), place(right, own)
    for start in range(0, len(known), COLUMNS):
        width = min(COLUMNS, len(known) - start)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        m = (lc >= start) & (lc < start + width)
        a[lr[m], lc[m] - start] = 1
        m = (rc >= start) & (rc < start + width)
        b[rr[m], rc[m] - start] = 1
        out += a @ b.T
    return out


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether 100 * intersection >= 80 * union."""
    return 5 * common >= 4 * (n[:, None] + m[None, :] - common)


def _components(links: np.ndarray) -> np.ndarray:
    """The least number of each set's component in a square link matrix."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label[None, :], len(links)).min(1)
        if (new == label).all():
            return label
        label = new


def group(sets: DataFrame, turn: int) -> DataFrame:
    """Groups of at most GROUP sets that are near in the order of a round's min-hashes: group, ids, ns, the set that each
    one's component within the group is contracted to (roots), whether it goes on (goes), and tokens, as lists. Equal rows
    are one set."""
    by, then = f"h{turn}", f"h{(turn + 1) % ROUNDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        pivot = None  # the best linked set of the group before, with the last min-hash there

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal pivot
            held = [*rows, pivot] if pivot and pivot[2] == rows[0][2] and pivot[0] not in {r[0] for r in rows} else rows
            ids, ns, tokens = np.array([r[0] for r in held]), np.array([r[1] for r in held]), [r[3] for r in held]
            links = linked(overlaps(tokens, tokens), ns, ns)
            np.fill_diagonal(links, True)
            part, degree = _components(links), links.sum(1)
            if len(held) > len(rows):
                degree[-1] = len(held) + 1  # what it stands for goes on
            best = np.zeros(len(held), np.int64)
            for i in np.lexsort((-ids, degree)):
                best[part[i]] = i
            roots, last = best[part], np.flatnonzero([r[2] == rows[-1][2] for r in held[: len(rows)]])
            top = held[roots[last[np.argmax(degree[last])]]]
            pivot = (top[0], top[1], rows[-1][2], top[3])
            n = len(rows)
            ranked = np.lexsort((ids, np.arange(len(held)) != roots, part))  # of each component its root first
            goes = np.zeros(len(held), bool)
            goes[ranked] = np.arange(len(held)) - np.searchsorted(part[ranked], part[ranked]) < SPOKESMEN
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids[:n], ns[:n], ids[roots[:n]])]
            return pa.RecordBatch.from_arrays([pa.array([_name(ids[:n].tobytes() + ns[:n].tobytes())]), *lists, pa.array([goes[:n]], pa.list_(pa.bool_())), pa.array([[t.tobytes() for t in tokens[:n]]], pa.list_(pa.binary()))], ["group", "ids", "ns", "roots", "goes", "tokens"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), map(np.copy, _tokens(batch.column(3))), strict=True):
                if rest and rest[-1][0] == row[0] and np.array_equal(rest[-1][3], row[3]):
                    continue
                if len(rest) == GROUP:
                    yield pack(rest)
                    rest = []
                rest.append(row)
        if rest:
            yield pack(rest)

    count = sets.agg(F.sum("n")).first()[0] or 0
    ordered = sets.repartitionByRange(max(1, 8 * count // PARTITION), by, then, "id").sortWithinPartitions(by, then, "id").select("id", "n", by, "tokens")
    return ordered.mapInArrow(run, "group long, ids array<long>, ns array<long>, roots array<long>, goes array<boolean>, tokens array<binary>")


def members(groups: DataFrame) -> DataFrame:
    """group, place in it, id, n, root and goes."""
    one = groups.select("group", F.posexplode(F.arrays_zip("ids", "ns", "roots", "goes")).alias("place", "m"))
    return one.select("group", "place", F.col("m.ids").alias("id"), F.col("m.ns").alias("n"), F.col("m.roots").alias("root"), F.col("m.goes").alias("goes"))


_PROBES = "token long, own long, id long, component long, n long, place long, size long, room long"


def _reach(back: pa.Table, placed: pa.Table) -> pa.Table:
    """_PROBES of a group. back: packed tokens, groups and rows, of what other groups have too; placed: place, id, n, component.

    A set of n tokens, in order the rarest first, has its i-th token looked up if i <= n // 5 and may be found by it if
    i <= n // 9. Rows to be found by (id null) are one for each component and size of its sets that have the token, with
    the most of 9 * (n - i) - 4 * n.
    """
    empty = pa.schema([(name, pa.int64()) for name in (x.split()[0] for x in _PROBES.split(", "))]).empty_table()
    if not back.num_rows or not placed.num_rows:
        return empty
    numbers = lambda t, c: t.column(c).to_numpy()
    at = np.argsort(numbers(placed, "place"))
    ids, sizes, component = (numbers(placed, c)[at] for c in ("id", "n", "component"))
    token, row, groups = _of(back.column("tokens"), np.int64), _of(back.column("rows"), np.int32), _of(back.column("groups"), np.int32)
    order = np.lexsort((token, groups, row))
    token, row = token[order], row[order]
    have = np.bincount(row, minlength=len(ids))  # shared tokens of each set; the others come before them
    place = np.arange(len(row)) - (np.cumsum(have) - have)[row] + (sizes - have)[row]
    n = sizes[row]
    asks = place <= n // 5
    found = np.flatnonzero(place <= n // 9)
    found = found[np.lexsort((n[found], component[row[found]], token[found]))]
    t, c, m, room = token[found], component[row[found]], n[found], (9 * (n - place) - 4 * n)[found]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])])) if len(t) else np.zeros(0, np.int64)
    own = placed.column("group")[0].as_py()
    same = lambda k: pa.array(np.full(k, own))
    null = lambda k: pa.nulls(k, pa.int64())
    a, b = int(asks.sum()), len(first)
    over = lambda f, x: pa.array(f.reduceat(x, first)) if b else null(0)
    asking = [token[asks], same(a), ids[row[asks]], component[row[asks]], n[asks], place[asks], null(a), null(a)]
    finding = [t[first], same(b), null(b), c[first], null(b), null(b), m[first], over(np.maximum, room)]
    return pa.concat_tables([pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=empty.schema) for columns in (asking, finding)])


def query_links(sets: DataFrame, groups: DataFrame, known: DataFrame, near: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between members of different groups that aren't in one component of `known` (id, component).

    A set first asks whole components, then opens one group of each that it may link with, that of the set on which most
    links of `near` (a, b) were contracted, and the component's other groups, if it has any, only where that gave no link, by
    the tokens by which they met.
    """
    of = members(groups)
    buckets = max(16, int((of.agg(F.sum("n")).first()[0] or 0) / BUCKET))
    placed = tables.write(of.join(known, "id", "left").select("group", F.col("place").cast("long").alias("place"), "id", "n", F.coalesce("component", "id").alias("component")), "placed")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _tokens(packed.values)
                yield _deal(name, np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), buckets)

    def meet(table: pa.Table) -> pa.Table:
        """Of a bucket: the tokens that two groups or more have, how many have them, and where they stand."""
        message, row, token, number = _meeting(table)
        pairs = np.unique(number.astype(np.int64) << 32 | message)
        groups = np.bincount(pairs >> 32)[number]
        some = groups > 1
        return _packed(table, message[some], "group", tokens=token[some], rows=row[some], groups=groups[some].astype(np.int32))

    back = groups.select("group", "tokens").mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(meet, "group long, tokens binary, rows binary, groups binary")
    probes = tables.write(back.groupBy("group").cogroup(placed.groupBy("group")).applyInArrow(_reach, _PROBES), "probes")
    asks = probes.where("id is not null").select("token", "own", "id", F.col("component").alias("mine"), "n", "place")
    has = probes.where("id is null").select("token", F.col("own").alias("group"), "component", "size", "room")
    # y of m tokens, of x's size at most, has place j of the token: both 9 * (n - place) and 9 * (m - j) reach 4 * (n + m)
    may = "component <> mine and size <= n and 5 * size >= 4 * n and 4 * (n + size) <= 9 * (n - place) and 4 * n <= room"
    whole = has.groupBy("token", "component", "size").agg(F.max("room").alias("room"))
    meetings = tables.write(asks.join(whole, "token").where(may).drop("size", "room").distinct(), "meetings")
    met = tables.write(meetings.select("id", "component").distinct(), "met")
    best = near.groupBy("b").agg(F.count("*").alias("links")).withColumnRenamed("b", "id")
    rank = F.struct(F.coalesce("links", F.lit(0)), "group")
    homes = tables.write(placed.join(best, "id", "left").groupBy("component").agg(F.max(rank).getField("group").alias("group")), "homes")
    at_home = tables.write(met.join(homes, "component").select("id", "group").distinct(), "at-home")
    links = tables.write(_opened(sets, groups, at_home, tables, "home"), "home-links")
    done = links.join(placed.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component").distinct()
    others = tables.write(has.join(homes.withColumnRenamed("group", "home"), "component").where("group <> home").drop("home"), "others")
    rest = met.join(done, ["id", "component"], "left_anti").join(others.select("component").distinct(), "component", "left_semi")
    again = meetings.join(rest, ["id", "component"], "left_semi").join(others, ["token", "component"]).where(f"group <> own and {may}")
    elsewhere = tables.write(again.select("id", "group").distinct().join(at_home, ["id", "group"], "left_anti"), "elsewhere")
    return links.unionByName(_opened(sets, groups, elsewhere, tables, "elsewhere"))


def _opened(sets: DataFrame, groups: DataFrame, pairs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Links (a, b) of the sets and groups of pairs (id, group), one of each set to each component within a group."""
    load = tables.write(pairs.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), f"{name}-load")
    asking = pairs.join(load, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "group", "part")
    own = tables.write(asking.select("id").distinct(), f"{name}-asking")
    asked = asking.join(sets.select("id", "n", "tokens").join(within(own, own.count(), BROADCAST_KEYS), "id", "left_semi"), "id").select("group", "part", "id", "n", "tokens")
    opened = groups.join(within(load, load.count(), BROADCAST_KEYS), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", "part", "ids", "ns", "roots", F.col("tokens").alias("packed"))

    def compare(queries: pa.Table, held: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if queries.num_rows:
            ids, n, own = queries.column("id").to_numpy(), queries.column("n").to_numpy(), _tokens(queries.column("tokens"))
            for i in range(held.num_rows):
                sets, others, m = _tokens(held.column("packed")[i].values), held.column("ids")[i].values.to_numpy(), held.column("ns")[i].values.to_numpy()
                union = np.unique(np.concatenate(sets))
                bound = np.array([np.isin(t, union, assume_unique=True).sum() for t in own])
                at = np.flatnonzero(5 * bound >= 4 * n)
                left, right = np.nonzero(linked(overlaps([own[i] for i in at], sets), n[at], m))
                _, root = np.unique(held.column("roots")[i].values.to_numpy(), return_inverse=True)
                _, one = np.unique(left * len(sets) + root[right], return_index=True)
                left, right = left[one], right[one]
                a.append(ids[at][left])
                b.append(others[right])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return asked.groupBy("group", "part").cogroup(opened.groupBy("group", "part")).applyInArrow(compare, "a long, b long")


def _of_one_key(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a key that has several, as its rows are one document. known: key, digest."""
    several = known.groupBy("key").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("key")
    pairs = known.join(several, "key", "left_semi").distinct().join(classes, "digest").select("key", "least")
    least = pairs.groupBy("key").agg(F.min("least").alias("a"))
    return pairs.join(least, "key").where("a <> least").select("a", F.col("least").alias("b"))


def join(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id, the smallest key that links reach; one row for each row of docs."""
    tables = Tables(docs.sparkSession, "jaccard")
    signed = tables.write(sign(docs, text=text, key=key), "signed")
    sized = tables.write(signed.select("key", "n", "digest"), "sized")
    known = sized.where("n > 0 and key is not null").select("key", "digest")
    classes = tables.write(known.groupBy("digest").agg(F.min("key").alias("least")), "classes")
    left = tables.write(candidates(signed, tables).join(classes, "digest").select(F.col("least").alias("id")).distinct(), "left")
    tables.drop("signed", "hits")
    sets = tables.write(set_table(docs, left, left.count(), text=text, key=key), "sets")
    groups = tables.write(group(sets, 0), "groups")
    found, made = [], groups
    for turn in range(ROUNDS):
        part = tables.write(members(made).select("id", "root", "goes"), f"round-{turn}")
        found.append(part.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        if turn < ROUNDS - 1:
            on = tables.write(part.where("goes").select("id").distinct(), f"on-{turn}")
            made = group(sets.join(within(on, on.count(), BROADCAST_KEYS), "id", "left_semi"), turn + 1)
    near = functools.reduce(DataFrame.unionByName, found)
    reached = tables.write(connected(near), "near")
    more = tables.write(query_links(sets, groups, reached, near, tables), "more")
    tables.drop("probes", "groups", "sets")
    reached = tables.write(connected(near.unionByName(more).unionByName(_of_one_key(known, classes))), "reached")
    named = classes.join(reached, F.col("least") == F.col("id"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "least").alias("component"))
    return sized.join(named, F.col("digest") == F.col("of"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id")
    )
