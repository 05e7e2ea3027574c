import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import webp

DRAW = random.Random(9)


class Coder:
    """Writes entropy-coded images with every feature of the format; codes are Huffman of what is written."""

    def __init__(self, width, height):
        self.out = webp.BitWriter()
        webp.head(self.out, width, height)

    def code(self, counts):
        lengths = webp.code_lengths(counts, 9)
        self.out.write(*webp.code_bits(lengths))
        symbols, codes = webp.canonical(lengths)
        return {int(s): (webp.reverse(int(c), int(lengths[s])) if len(symbols) > 1 else 0, int(lengths[s]) if len(symbols) > 1 else 0) for s, c in zip(symbols, codes, strict=True)}

    def image(self, argb, outermost=False, cache=0, copies=True, meta=None):
        """argb: height x width. meta: (bits, group of each block) for an entropy image."""
        height, width = argb.shape
        flat, out = argb.ravel().tolist(), self.out
        out.write(1 if cache else 0, 1)
        if cache:
            out.write(cache, 4)
        groups = 1
        if outermost:
            out.write(1 if meta else 0, 1)
            if meta:
                out.write(meta[0] - 2, 3)
                self.image(meta[1].astype(np.uint32) << 8)
                groups = int(meta[1].max()) + 1
        held, symbols, at = {}, [], 0
        while at < len(flat):
            group = int(meta[1][at // width >> meta[0], at % width >> meta[0]]) if meta else 0
            length, back = 0, 0
            if copies:
                for b in (1, 2, width, width + 1, 3 * width + 5, 200):
                    n = 0
                    while 0 < b <= at and at + n < len(flat) and n < 3000 and flat[at + n] == flat[at + n - b]:
                        n += 1
                    if n > max(length, 2):
                        length, back = n, b
            if length:
                near = [i + 1 for i, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == back]
                symbols.append((group, "copy", length, near[0] if near else back + 120))
                step = length
            elif cache and held.get(slot(flat[at], cache)) == flat[at]:
                symbols.append((group, "cache", slot(flat[at], cache), 0))
                step = 1
            else:
                symbols.append((group, "literal", flat[at], 0))
                step = 1
            for p in flat[at : at + step]:
                if cache:
                    held[slot(p, cache)] = p
            at += step
        sizes = [280 + (1 << cache if cache else 0), 256, 256, 256, 40]
        counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
        for g, kind, a, b in symbols:
            c = counts[g]
            if kind == "literal":
                c[0][a >> 8 & 255] += 1
                c[1][a >> 16 & 255] += 1
                c[2][a & 255] += 1
                c[3][a >> 24] += 1
            elif kind == "copy":
                c[0][256 + prefix(a)[0]] += 1
                c[4][prefix(b)[0]] += 1
            else:
                c[0][280 + a] += 1
        for c in counts:
            for k in c:
                if not k.any():
                    k[0] = 1
            if (c[0][:256] == 0).all():
                c[0][0] = 1
        codes = [[self.code(k) for k in c] for c in counts]
        for g, kind, a, b in symbols:
            green, red, blue, alpha, distance = codes[g]
            if kind == "literal":
                for code, v in ((green, a >> 8 & 255), (red, a >> 16 & 255), (blue, a & 255), (alpha, a >> 24)):
                    out.write(*code[v])
            elif kind == "copy":
                for code, base, v in ((green, 256, a), (distance, 0, b)):
                    p, more, extra = prefix(v)
                    out.write(*code[base + p])
                    out.write(extra, more)
            else:
                out.write(*green[280 + a])

    def file(self):
        return webp.container(self.out.value.to_bytes((self.out.n + 7) // 8, "little"))


def slot(p, bits):
    return (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits)


def prefix(value):
    """(prefix, extra bits, their value) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)


def picture(height, width, colours=None):
    rng = np.random.default_rng(height * 1000 + width)
    if colours:
        table = rng.integers(0, 1 << 24, colours, dtype=np.uint32) | np.uint32(0xFF000000)
        return table[rng.integers(0, colours, (height, width))]
    soft = (np.add.outer(np.arange(height) * 3, np.arange(width) * 2) + rng.integers(0, 9, (height, width))).astype(np.uint32)
    return np.uint32(0xFF000000) | (soft & 255) << 16 | (soft * 2 & 255) << 8 | (soft * 5 & 255)


def rgb(argb):
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype(np.uint8)


def check(coder, argb):
    data = coder.file()
    assert (webp.Image(data).rgb() == rgb(argb)).all()
    many = webp.decode([data] * (webp.FEW + 3) + [webp.encode(rgb(argb))])  # side by side
    assert all((x == rgb(argb)).all() for x in many)


@pytest.mark.parametrize(("cache", "copies"), [*itertools.product([0, 1, 6], [False, True])])
def test_copies_and_colour_cache(cache, copies):
    for argb in (picture(13, 17, 5), picture(9, 40, 60), np.full((5, 300), 0xFF102030, np.uint32)):
        c = Coder(argb.shape[1], argb.shape[0])
        c.out.write(0, 1)
        c.image(argb, True, cache, copies)
        check(c, argb)


def test_entropy_image():
    argb = picture(20, 22, 40)
    groups = np.array([[0, 1, 2], [2, 0, 1], [1, 1, 0]])
    c = Coder(22, 20)
    c.out.write(0, 1)
    c.image(argb, True, 4, True, (3, groups))
    check(c, argb)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palette(colours):
    argb = picture(11, 19, colours)
    table = np.unique(argb)
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    index = np.searchsorted(table, argb)
    each, width = 8 >> packed, -(-19 >> packed)
    wide = np.zeros((11, width << packed), np.int64)
    wide[:, :19] = index
    bundled = sum(wide[:, k :: 1 << packed] << each * k for k in range(1 << packed))
    c = Coder(19, 11)
    c.out.write(1 | 3 << 1 | (len(table) - 1) << 3, 11)
    parts = webp._split(table)
    c.image(webp._join(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int32)))[None])
    c.out.write(0, 1)
    c.image(np.uint32(0xFF000000) | bundled.astype(np.uint32) << 8, True)
    check(c, argb)


def predicted(argb, modes, size):
    """What a predictor leaves, pixel by pixel, by the definition."""
    height, width = argb.shape
    c, out = webp._split(argb), np.zeros((height, width, 4), np.int32)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = np.array([255, 0, 0, 0]) if x == 0 else c[0, x - 1]
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = webp.predict(int(modes[y >> size, x >> size]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            out[y, x] = c[y, x] - guess
    return webp._join(out)


@pytest.mark.parametrize("mode", [*range(14), None])
def test_predictors(mode):
    argb, size = picture(10, 13), 2
    modes = np.full((3, 4), mode) if mode is not None else np.arange(12).reshape(3, 4) + 1
    c = Coder(13, 10)
    c.out.write(1 | 0 << 1 | (size - 2) << 3, 6)
    c.image(np.uint32(0xFF000000) | modes.astype(np.uint32) << 8)
    c.out.write(0, 1)
    c.image(predicted(argb, modes, size), True)
    check(c, argb)


def test_predictions_by_hand():
    p = lambda *x: np.array([255, *x], np.int32)
    left, top, corner, right = p(10, 20, 30), p(40, 10, 31), p(20, 30, 0), p(7, 7, 7)
    for mode, value in {0: (0, 0, 0), 1: (10, 20, 30), 2: (40, 10, 31), 3: (7, 7, 7), 4: (20, 30, 0), 5: (24, 11, 24), 6: (15, 25, 15), 7: (25, 15, 30), 8: (30, 20, 15), 9: (23, 8, 19), 10: (19, 16, 17), 12: (30, 0, 61), 13: (27, 8, 45)}.items():
        assert webp.predict(mode, left, top, corner, right)[1:].tolist() == list(value), mode
    # the sums of differences of the guess (30, 0, 61) from left and top are 71 and 50
    assert webp.predict(11, left, top, corner, right)[1:].tolist() == [40, 10, 31]


def test_green_and_cross_colour():
    argb, size = picture(9, 14), 3
    elements = np.random.default_rng(1).integers(0, 1 << 24, (2, 2), dtype=np.uint32) | np.uint32(0xFF000000)
    signed = lambda v: (int(v) & 255 ^ 128) - 128
    c1 = webp._split(argb)
    crossed = c1.copy()
    for y in range(9):
        for x in range(14):
            e = int(elements[y >> size, x >> size])
            g = signed(c1[y, x, 2])
            crossed[y, x, 1] = c1[y, x, 1] - (signed(e) * g >> 5)
            crossed[y, x, 3] = c1[y, x, 3] - (signed(e >> 8) * g >> 5) - (signed(e >> 16) * signed(c1[y, x, 1]) >> 5)
    less = crossed.copy()
    less[..., 1] -= crossed[..., 2]
    less[..., 3] -= crossed[..., 2]
    c = Coder(14, 9)
    c.out.write(1 | 1 << 1 | (size - 2) << 3, 6)
    c.image(elements)
    c.out.write(1 | 2 << 1, 3)
    c.out.write(0, 1)
    c.image(webp._join(less), True, copies=False)
    check(c, argb)
    assert (webp.decode([c.file()] * 3)[2] == rgb(argb)).all()


def test_code_length_runs_and_simple_codes():
    """A code whose lengths are written with runs reads as one written plainly."""
    lengths = np.zeros(256, np.uint8)
    lengths[[65, 66, 67, 68]] = 2
    out = webp.BitWriter()
    out.write(0, 1)
    out.write(0, 4)  # the lengths of 17, 18, 0 and 1
    for size in (2, 2, 2, 2):
        out.write(size, 3)
    reader = webp.BitReader(out.value.to_bytes(8, "little"))
    with pytest.raises(ValueError):
        webp.read_code(reader, 256)  # nothing but zeros
    out = webp.BitWriter()
    out.write(0, 1)
    out.write(15, 4)
    want = {2: 1, 16: 2, 18: 2}
    for symbol in webp.LENGTH_ORDER:
        out.write(want.get(symbol, 0), 3)
    out.write(0, 1)
    code = {2: (0, 1), 16: (0b01, 2), 18: (0b11, 2)}  # reversed canonical codes 0, 10, 11
    for symbol, extra in ((18, (54, 7)), (2, (0, 0)), (16, (0, 2)), (18, (127, 7)), (18, (38, 7))):
        out.write(*code[symbol])
        out.write(*extra)
    got = webp.read_code(webp.BitReader(out.value.to_bytes(out.n // 8 + 9, "little")), 256)
    assert (got.lengths == lengths).all()


def test_damage_is_an_error():
    data = webp.encode(rgb(picture(8, 64)))
    for bad in (b"", data[:40], b"RIFX" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode([bad])
    with pytest.raises(ValueError):
        webp.decode([webp.container(data[20 : len(data) // 2])])


def test_columns(spark, docs_of):
    texts = [None, "", "x", "y" * 192, "é漢🙂" * 500, "z" * 200_000, "a b", "a b", "\x00" * 7, bytes(range(1, 128)).decode() * 30]
    docs = docs_of(texts).withColumn("media", F.lit("clash"))
    got = {r["doc_id"]: r for r in webp.read(webp.store(docs)).collect()}
    for i, t in enumerate(texts):
        want = webp.padded((t or "").encode())
        assert bytes(got[i]["payload"]) == want and got[i]["payload_bytes"] == len(want) and len(want) % 192 == 0
        assert got[i]["n_bytes"] == len((t or "").encode()) and bytes(got[i]["media"])[:4] == b"RIFF"
    assert got[6]["media"] == got[7]["media"] and got[6]["feature"] == got[7]["feature"] != got[3]["feature"]
    assert webp.read(webp.store(docs_of([]))).count() == 0


def test_images_wider_than_a_row():
    payload = bytes(DRAW.randrange(256) for _ in range(192)) * 16_500
    pixels = webp.pixels_of(payload)
    assert pixels.shape == (8250, 128, 3) and webp.decode([webp.encode(pixels)])[0].tobytes()[: len(payload)] == payload


def paths(files):
    """How many of the files use each path of the decoder."""
    found = {}
    for data in files:
        image = webp.Image(data)
        undone = "".join(str(u.__code__.co_names) + u.__name__ for u in image.undo)
        stream = image.stream
        assert stream.common()
        used = {
            "palette": "undo_palette" in undone, "predictor": "undo_predictor" in undone, "green": "undo_subtract_green" in undone,
            "references": any(g[0].symbols.max() >= 256 and (g[0].symbols[g[0].symbols < 280] >= 256).any() for g in stream.groups),
            "cache": stream.cache > 0, "groups": stream.meta is not None,
        }
        for name, yes in used.items():
            found[name] = found.get(name, 0) + yes
    return found


def test_the_encoder_takes_what_pays():
    draw = np.random.default_rng(1)
    noise = draw.integers(0, 256, (40, 64, 3)).astype(np.uint8)
    slope = (np.arange(64)[None, :, None] * 2 + np.arange(90)[:, None, None] * 3 + draw.integers(0, 4, (90, 64, 3))).astype(np.uint8)
    falling = np.cumsum(draw.integers(0, 3, (90, 64, 3)), 0).astype(np.uint8)
    grey = noise.copy()
    grey[..., 0] = grey[..., 2] = grey[..., 1] + 1
    few = draw.choice(np.array([[1, 2, 3], [200, 100, 7], [9, 9, 9], [0, 255, 0], [5, 6, 7]], np.uint8), (30, 64))
    lines = np.tile(noise[:7], (9, 1, 1))
    words = draw.integers(97, 123, (900, 3)).astype(np.uint8)[draw.zipf(1.3, (150, 64)) % 900]
    halves = np.concatenate([draw.integers(48, 58, (192, 64, 3)), draw.integers(97, 123, (192, 64, 3))]).astype(np.uint8)
    images = [noise, slope, falling, grey, few, lines, words, halves, np.zeros((1, 64, 3), np.uint8), np.full((3, 64, 3), 32, np.uint8)] * 3
    files = webp.encode_all(images)
    assert all((x == y).all() for x, y in zip(webp.decode(files), images, strict=True))
    assert all((webp.Image(x).rgb() == y).all() for x, y in zip(files, images, strict=True))
    assert all(n >= 3 for n in paths(files).values()), paths(files)
    assert files[:10] == [webp.encode(x) for x in images[:10]]


def test_random_images_come_back():
    draw = np.random.default_rng(2)
    images = []
    for _ in range(120):
        size = int(draw.integers(1, 40)), int(draw.choice([1, 3, 64, 128]))
        colours = draw.integers(0, 256, (int(draw.choice([1, 2, 3, 5, 17, 300])), 3)).astype(np.uint8)
        images.append(colours[draw.integers(0, len(colours), size)])
    assert all((x == y).all() for x, y in zip(webp.decode(webp.encode_all(images)), images, strict=True))


def test_stored_images_of_the_query_use_the_paths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stored = webp.store(docs).collect()
    used = paths([bytes(r["media"]) for r in stored])
    assert used["references"] > 0.5 * len(stored) and used["cache"] > 0.1 * len(stored) and used["palette"] > 0, used
