import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import components, decontamination, jaccard, substring_dedup
from cairn.llm.textkernel import SPACE, words


def sentence(draw, n=6):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(n)) + draw.choice(".!?")


def brute_cut(rows, run=3, least=10):
    """Text and sentences removed, by the definition."""

    def cut(t):
        at = sorted({0} | {i for i, c in enumerate(t) if c in "\r\n" or i and t[i - 1] in ".!?" and c in " \t\n\r\x0b\x0c"}) + [len(t)]
        out = []
        for a, b in zip(at, at[1:], strict=False):
            w = tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b])))
            if w:
                out.append((a, w))
        return out

    seen, result = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        s, gone = cut(t or ""), set()
        for i in range(len(s) - run + 1):
            k = tuple(w for _, w in s[i : i + run])
            if sum(map(len, k)) >= least and seen.setdefault(k, (d, i)) != (d, i):
                gone.update(range(i, i + run))
        if gone:
            ends = [a for a, _ in s[1:]] + [len(t)]
            t = (t[: s[0][0]] + "".join(t[a:e] for j, ((a, _), e) in enumerate(zip(s, ends, strict=True)) if j not in gone)).strip()
        result[d] = (t, len(gone))
    return result


def test_substring_dedup_equals_brute_force(spark, docs_of):
    draw = random.Random(1)
    passages = [" ".join(sentence(draw) for _ in range(5)) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [sentence(draw, draw.choice([1, 3, 6])) for _ in range(draw.randrange(8))]
        if i % 2:
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages))
        if i % 9 == 0:
            parts *= 2
        texts.append(draw.choice([" ", "\n"]).join(parts))
    texts += [None, "", " \n. !", texts[3], texts[3].upper(), "É" + texts[5], sentence(draw) * 3000]
    docs = docs_of(texts).withColumns({"n_removed": F.lit("clash"), "_key": F.lit(1), "_content": F.lit(2), "_places": F.lit(3)})
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.dedup_spans(docs).collect()}
    assert got == brute_cut(list(enumerate(texts)))
    assert sum(n for _, n in got.values()) > 50


def test_substring_dedup_of_odd_tables(spark, docs_of):
    draw = random.Random(2)
    t = " ".join(sentence(draw) for _ in range(4))
    twice = docs_of([t, t, None], ids=[4, 4, None])
    assert [r["n_removed"] for r in substring_dedup.dedup_spans(twice).collect()] == [0, 0, 0]
    nulls = docs_of([t, t], ids=[None, 9])
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_spans(nulls).collect()} == {None: 4, 9: 0}
    assert substring_dedup.dedup_spans(docs_of([])).count() == 0


def stretches(text, n=51):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_substring_dedup_of_passages_without_whole_sentences(spark, docs_of):
    """Passages of 51 words or more with 0 to 2 stops, as table rows, on one line, or from the middle of a sentence."""
    draw = random.Random(5)
    say = lambda n: ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passages = []
    for n in (51, 52, 60, 90, 150):
        for stops in (0, 1, 2):
            w = say(n)
            for k in range(stops):
                w[(k + 1) * n // (stops + 1)] += "."
            passages.append((" | " if n == 90 else " ").join(w))
    texts = []
    for i, p in enumerate(passages * 3):  # three copies, framed inside a sentence
        texts.append(f"{' '.join(say(i % 7 + 2))} {p} {' '.join(say(9))}. {' '.join(say(7))}.")
    plain = [" ".join(say(40)) + ". " + " ".join(say(30)) for _ in range(5)]
    inside = " ".join(say(60)) + " " + passages[0] + " " + " ".join(say(30)) + " " + passages[0].upper() + " end"
    texts += [*plain, passages[0], inside]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_spans(docs_of(texts)).collect()}
    n = len(passages)
    assert [got[i]["text"] for i in range(n)] == texts[:n] and all(got[i]["n_removed"] == 0 for i in range(n))
    assert [got[3 * n + i]["text"] for i in range(len(plain))] == plain
    seen = set()
    for d in sorted(got):
        here = stretches(got[d]["text"])
        assert not here & seen
        seen |= here
    for d in range(n, 3 * n):  # the frame stays, and at most 24 words of either end of the passage
        words_of = got[d]["text"].split()
        assert got[d]["n_removed"] > 0 and texts[d].startswith(" ".join(words_of[: d % 7 + 2])) and texts[d].endswith(" ".join(words_of[-7:]))


def test_substring_dedup_within_a_document_by_words(spark, docs_of):
    draw = random.Random(6)
    say = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = say(80)
    (row,) = substring_dedup.dedup_spans(docs_of([f"{say(5)} {passage} {say(5)} {passage} {say(5)}"])).collect()
    assert row["n_removed"] == 1 and 80 + 15 <= len(row["text"].split()) <= 80 + 15 + 48
    text, n = substring_dedup._cut_words("Aa bb. Cc dd. (Ee) ff", [1, 4], 2)
    assert (text, n) == ("Aa  dd.", 3)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(rows, items, size=10):
    windows = {}
    for item, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark, docs_of):
    draw = random.Random(4)
    vocabulary = ["the", "of", "a", *(f"w{i}" for i in range(30))]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    item_texts = [" ".join(say(draw.choice([1, 4, 9, 10, 11, 25]))) for _ in range(25)] + ["a a a a a a a a a a a a", "The  OF-éa", None, "", "..", "zq"]
    texts = []
    for i in range(60):
        parts = [" ".join(say(draw.randrange(60)))]
        if i % 2:
            w = words_of(draw.choice(item_texts[:25]))
            a = draw.randrange(max(1, len(w) - 9))
            parts += [draw.choice([" ", ", ", "\n"]).join(w[a : a + draw.choice([8, 10, 12])]).title(), " ".join(say(5))]
        texts.append("; ".join(parts))
    texts += [None, "", "...", "a " * 5000, "THE of! éA", "the of Éa", texts[1]]
    items = list(enumerate(item_texts)) + [(3, item_texts[3]), (None, item_texts[4])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs_of(texts), benchmark)
    rows = sorted(((r["doc"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str)
    expected = brute_hits(list(enumerate(texts)), [x for x in items if x[0] is not None])
    # an item without an id gives hits but no name
    assert [(d, n, h) for d, n, h, _ in rows] == [(d, n, h) for d, n, h, _ in expected] and [i for *_, i in rows] == [i for *_, i in expected]
    assert sum(h > 0 for _, _, h, _ in rows) > 10


def test_decontamination_of_odd_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = decontamination.decontaminate(docs_of(["x one two three", "x one two three", None], ids=[None, 7, 7]), benchmark)
    assert sorted(((r["doc"] or -1), r["n_words"], r["n_hit"]) for r in got.collect()) == [(-1, 4, 3), (7, 0, 3), (7, 4, 3)]
    assert decontamination.decontaminate(docs_of([]), benchmark).count() == 0
    assert decontamination.decontaminate(docs_of(["a b"]), benchmark.limit(0)).first()["n_hit"] == 0


def test_proximity(spark, docs_of):
    items = decontamination.item_words(spark.createDataFrame([(1, "red fox")], "item_id long, text string")).persist()
    docs = docs_of(["fox is red", "red x x x fox", "red", "fox fox red"])
    index = decontamination.build_index(docs, items.select(F.explode("words").alias("term")))
    got = sorted((r["doc"], r["end"]) for r in decontamination.proximity_matches(index, items, 3).collect())
    assert got == [(0, 2), (3, 2)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("group", [3, 128])
def test_jaccard_join_equals_brute_force(spark, docs_of, monkeypatch, group):
    draw = random.Random(8)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "QUERIES", 4)
    common = [f"c{i}" for i in range(30)]
    say = lambda n: [f"w{draw.randrange(2000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = say(draw.choice([3, 8, 40, 120]))
        if draw.random() < 0.5:
            base[2:2] = common
        for _ in range(draw.choice([1, 6, 14])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
            texts.append(draw.choice([" ", "\n"]).join(copy))
    texts += [" ".join(say(60) + common) for _ in range(20)]
    draw.shuffle(texts)
    texts += [None, "", " \t\n", "One two", "one  TWO", texts[0].upper(), "x " * 5000]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(texts).withColumn("tokens", F.lit(1))).collect())
    assert got == brute_components(texts)
    assert len({c for *_, c in got}) < len(texts) - 15


def test_jaccard_of_a_large_cluster_over_many_partitions(spark, docs_of, monkeypatch):
    """Pieces of a cluster whose central sets don't all link, and a passage that stands in every text."""
    draw = random.Random(9)
    monkeypatch.setattr(jaccard, "PARTITION", 4000)
    monkeypatch.setattr(jaccard, "GROUP", 6)
    say = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    passage, base, texts = say(20), say(60), []
    for _ in range(90):
        copy = base + passage
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3])):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(say(60) + passage) for _ in range(40)]
    draw.shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(texts)).collect())
    assert got == brute_components(texts)
    of = [c for *_, c in got]
    assert max(map(of.count, of)) >= 50


def test_jaccard_of_odd_tables(spark, docs_of):
    assert jaccard.join(docs_of([])).count() == 0
    got = jaccard.join(docs_of(["a b c d e f", "a b c d e f", "x", "", "x", "a b c d e f"], ids=[5, None, 5, 6, 9, 8]))
    assert sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in got.collect()) == [(-1, 2, None), (5, 1, 5), (5, 2, 5), (6, 0, 6), (8, 2, 5), (9, 1, 5)]


def test_bounds_lose_no_link():
    """Any two linked sizes share the tokens that the filter counts on."""
    for n in range(1, 400):
        for m in range(-(-4 * n // 5), n + 1):
            least = -(-4 * (n + m) // 9)  # of a linked pair's intersection
            if least > m:
                continue
            assert n - least <= jaccard.most_missing(n) and m - least <= jaccard.most_missing(m)
            assert jaccard.needed(n) <= min(jaccard.sure(n), jaccard.sure(m)) and jaccard.needed(m) <= jaccard.sure(m)


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(300):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in components.connected(links).collect()} == label
    assert components.connected(links.limit(0)).count() == 0


def test_words_of_a_batch():
    data = np.frombuffer("Ab cd  AB\nxab cd".encode(), np.uint8)
    hashed, starts, ends, bounds = words(data, np.array([0, 9, 9, 11, len(data)]), SPACE)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"Ab", b"cd", b"AB", b"x", b"ab", b"cd"]
    assert hashed[0] == hashed[2] == hashed[4] and hashed[1] == hashed[5] and len(set(hashed.tolist())) == 3
    assert bounds.tolist() == [0, 3, 3, 4, 6]
