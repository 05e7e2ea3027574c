"""Media columns in lossless WebP: bytes as pixels, encoded, stored, read back and decoded.

The decoder takes any lossless (VP8L) image: simple and normal prefix codes, prefix code groups chosen by an entropy
image, back-references, colour cache, and the four transforms. The images of a batch are decoded together: one numpy
step reads the next symbol of every image, be it a literal, a colour of the cache or a back-reference; the last few
images, and those with codes that the encoder here doesn't write, are read symbol by symbol.

The encoder works on a batch too. For each image it takes the transform that makes the colours' entropy least, if any
does (palette, prediction from the left or from above, green subtracted), writes repeats of MATCH pixels or more as
back-references, has a colour cache where its hits outweigh its codes, and two code groups where the blocks of a long
image differ enough.

A payload is 3 bytes a pixel in rows of 64 pixels (wider beyond 16384 rows), so a payload of a multiple of 192 bytes
fills its image. Every row is encoded and decoded where it is read; the stored column is written as a table between.

Edge cases: null and empty texts are a payload of 192 spaces; equal payloads have equal images; a payload that doesn't
fill the last row of a wide image is padded with zeros, which its stored length tells apart; other columns than those
kept are ignored, so clashing names do no harm; an empty table gives an empty table. Bytes that aren't a lossless
WebP image are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



#: Bytes of a row of pixels, pixels of a row, and most rows.
ROW, WIDTH, MOST_ROWS = 192, 64, 1 << 14
#: Bits of the longest prefix code and of the largest colour cache that the encoder writes and the common decoder takes.
LONGEST, CACHE = 9, 8
#: Pixels of the shortest back-reference written, and of the longest that the format has.
MATCH, LONGEST_MATCH = 4, 4096
#: Share of the plain cost that a transform must save, and bits that a second code group costs, about.
SAVED, GROUP_COST = 0.02, 2500
#: Binary logarithm of the side of a block of the entropy image and of a predictor block.
BLOCK = 6
#: Images so few that they are read symbol by symbol.
FEW = 12
#: Images and bytes that are decoded together.
TOGETHER, TOGETHER_BYTES = 4096, 6 << 20
# Fixed values of the format: order of the code length code's lengths, alphabet sizes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Distance codes 1 to 120: pixels near in two dimensions, the nearest first, then from the middle out, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 9], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return value

    def read_each(self, count: int, bits: int) -> np.ndarray:
        """`count` values of `bits` bits each."""
        first, last = self.at >> 3, (self.at + count * bits + 7) >> 3
        if last > len(self.data):
            raise ValueError("the image ends early")
        got = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first), bitorder="little")[self.at & 7 :][: count * bits]
        self.at += count * bits
        return got.reshape(count, bits) @ (1 << np.arange(bits))


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of nonzero length in the order of their codes, and their codes."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    sizes = lengths[symbols].astype(np.int64)
    top = int(sizes.max()) if len(sizes) else 0
    starts = np.concatenate([[0], np.cumsum(1 << (top - sizes))])
    return symbols, starts[:-1] >> (top - sizes)


_reversed = {bits: np.array([int(f"{i:0{bits}b}"[::-1], 2) if bits else 0 for i in range(1 << bits)]) for bits in range(LONGEST + 1)}


def reverse(code: int, bits: int) -> int:
    return int(f"{code:0{bits}b}"[::-1], 2) if bits else 0


class PrefixCode:
    """A code from its lengths. One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.symbols, codes = canonical(lengths)
        if not len(self.symbols):
            raise ValueError("a prefix code has no symbols")
        self.bits = 0 if len(self.symbols) == 1 else int(lengths[self.symbols].max())
        if self.bits:
            if int((1 << (self.bits - lengths[self.symbols].astype(np.int64))).sum()) != 1 << self.bits:
                raise ValueError("a prefix code isn't complete")
            self.constant = bool((lengths[self.symbols] == self.bits).all())
        self._table: list | None = None

    def packed(self, bits: int) -> np.ndarray:
        """For each value of the next `bits` bits: symbol << 4 | length."""
        if not self.bits:
            return np.full(1 << bits, int(self.symbols[0]) << 4, np.uint16)
        sizes = self.lengths[self.symbols].astype(np.int64)
        ordered = np.repeat((self.symbols << 4 | sizes).astype(np.uint16), 1 << (bits - sizes))
        return ordered[_reversed[bits]]

    def entries(self) -> list[tuple[int, int]]:
        """(symbol, length) for each value of the next bits."""
        if self._table is None:
            sizes = self.lengths[self.symbols].astype(np.int64)
            ordered = np.repeat(np.stack([self.symbols, sizes], 1), 1 << (self.bits - sizes), axis=0)
            order = _reversed[self.bits] if self.bits <= LONGEST else [reverse(i, self.bits) for i in range(1 << self.bits)]
            self._table = [tuple(x) for x in ordered[order].tolist()]
        return self._table

    def read(self, bits: BitReader) -> int:
        if not self.bits:
            return int(self.symbols[0])
        symbol, size = self.entries()[bits.peek(self.bits)]
        bits.at += size
        return symbol


@lru_cache(maxsize=256)
def prefix_code(lengths: bytes) -> PrefixCode:
    """Equal codes are one object: an image's colours often share one, and all images' code length codes do."""
    return PrefixCode(np.frombuffer(lengths, np.uint8))


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):  # simple
        two = bits.read(1)
        wide = bits.read(1)
        first = bits.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix_code(lengths.tobytes())
    count = 4 + bits.read(4)
    packed = bits.read(3 * count)
    of_lengths = bytearray(19)
    for i in range(count):
        of_lengths[LENGTH_ORDER[i]] = packed >> 3 * i & 7
    code = prefix_code(bytes(of_lengths))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise ValueError("more code lengths than symbols")
    if code.bits and code.constant and code.symbols[-1] < 16:  # no runs
        lengths[:left] = code.symbols[_reversed[code.bits][bits.read_each(left, code.bits)]]
        return prefix_code(lengths.tobytes())
    entries, size_of = (None, 0) if not code.bits else (code.entries(), code.bits)
    word, spent = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 + (left * 14 >> 3)], "little") >> (bits.at & 7), 0
    at, before, mask = 0, 8, (1 << size_of) - 1
    while at < alphabet and left:
        left -= 1
        symbol, size = entries[word & mask] if entries else (int(code.symbols[0]), 0)
        word >>= size
        spent += size
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        more, least = (2, 3) if symbol == 16 else (3, 3) if symbol == 17 else (7, 11)
        run = least + (word & (1 << more) - 1)
        word >>= more
        spent += more
        if at + run > alphabet:
            raise ValueError("a run of code lengths is too long")
        lengths[at : at + run] = before if symbol == 16 else 0
        at += run
    bits.at += spent
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    return prefix_code(lengths.tobytes())


def _extra(bits: BitReader, prefix: int) -> int:
    """The value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.read(more) + 1


class Stream:
    """The head of an entropy-coded image: colour cache, entropy image, code groups; then its pixels."""

    def __init__(self, bits: BitReader, width: int, height: int, outermost: bool):
        self.bits, self.width, self.height = bits, width, height
        self.cache = bits.read(4) if bits.read(1) else 0
        self.meta, self.meta_bits, groups = None, 0, 1
        if outermost and bits.read(1):
            self.meta_bits = bits.read(3) + 2
            self.meta = (Stream(bits, -(-width >> self.meta_bits), -(-height >> self.meta_bits), False).pixels() >> 8) & 0xFFFF
            groups = int(self.meta.max()) + 1
        greens = LITERALS + LENGTHS + ((1 << self.cache) if self.cache else 0)
        self.groups = [[read_code(bits, n) for n in (greens, 256, 256, 256, DISTANCES)] for _ in range(groups)]

    def common(self) -> bool:
        """Whether the images of a batch can be read together with this one."""
        alphas = {int(g[3].symbols[0]) for g in self.groups if not g[3].bits}
        return self.cache <= CACHE and len(alphas) == 1 and all(not g[3].bits and max(g[k].bits for k in (0, 1, 2, 4)) <= LONGEST for g in self.groups)

    def pixels(self, done: np.ndarray | None = None) -> np.ndarray:
        """Pixels as alpha, red, green, blue from the highest byte down, height x width, read one by one after those done."""
        bits, width, total = self.bits, self.width, self.width * self.height
        out: list[int] = [] if done is None else done.tolist()
        cache = [0] * (1 << self.cache) if self.cache else None
        if cache is not None:
            for p in out:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - self.cache)] = p
        group = self.groups[0]
        while len(out) < total:
            if self.meta is not None:
                y, x = divmod(len(out), width)
                group = self.groups[int(self.meta[y >> self.meta_bits, x >> self.meta_bits])]
            green, red, blue, alpha, distance = group
            symbol = green.read(bits)
            start = len(out)
            if symbol < LITERALS:
                r = red.read(bits)
                b = blue.read(bits)
                out.append(alpha.read(bits) << 24 | r << 16 | symbol << 8 | b)
            elif symbol < LITERALS + LENGTHS:
                length = _extra(bits, symbol - LITERALS)
                code = _extra(bits, distance.read(bits))
                if code > len(NEAR):
                    back = code - len(NEAR)
                else:
                    x, y = NEAR[code - 1]
                    back = max(1, x + y * width)
                if back > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the image")
                for _ in range(length):
                    out.append(out[-back])
            else:
                out.append(cache[symbol - LITERALS - LENGTHS])
            if cache is not None:
                for p in out[start:]:
                    cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - self.cache)] = p
            if bits.at > 8 * len(bits.data):
                raise ValueError("the image ends early")
        return np.array(out, np.uint32).reshape(self.height, width)


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue as a last axis of int32."""
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype(np.int32)


def _join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_left, top_right):
    """The prediction of a pixel, as channels; arrays of pixels work too."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        guess = left + top - top_left
        near_left = np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True)
        return np.where(near_left, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        # halves are cut towards zero
        return np.clip(m + np.trunc((m - top_left) / 2).astype(np.int32), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left),
        7: lambda: mean(left, top), 8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }.get(mode, lambda: np.broadcast_to(np.array([255, 0, 0, 0], np.int32), np.shape(left)))()


def undo_predictor(argb: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    """modes: of blocks of 2^size pixels. Rows of modes that don't look left are done at once, others pixel by pixel."""
    height, width = argb.shape
    out = _split(argb)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = np.repeat(modes[y >> size], 1 << size)[:width]
        if width == 1:
            continue
        before = above[:-1]
        after = np.concatenate([above[2:], row[:1]])
        alone = set(np.unique(kinds[1:]).tolist())
        if alone <= {0, 2, 3, 4, 8, 9, 14, 15}:
            for mode in alone:
                at = np.flatnonzero(kinds[1:] == mode)
                row[1:][at] = (row[1:][at] + predict(mode, before[at], above[1:][at], before[at], after[at])) & 255
        elif alone == {1}:
            row[:] = np.cumsum(row, 0) & 255
        else:
            for x in range(1, width):
                row[x] = (row[x] + predict(int(kinds[x]), row[x - 1], above[x], above[x - 1], after[x - 1])) & 255
    return _join(out)


def undo_cross_colour(argb: np.ndarray, elements: np.ndarray, size: int) -> np.ndarray:
    height, width = argb.shape
    of = np.repeat(np.repeat(elements, 1 << size, 0)[:height], 1 << size, 1)[:, :width]
    signed = lambda v: ((v & 255) ^ 128).astype(np.int32) - 128
    c, e = _split(argb), _split(of)
    green = signed(c[..., 2])
    red = c[..., 1] + (signed(e[..., 3]) * green >> 5)
    blue = c[..., 3] + (signed(e[..., 2]) * green >> 5) + (signed(e[..., 1]) * signed(red) >> 5)
    return _join(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _split(argb)
    return _join(np.stack([c[..., 0], c[..., 1] + c[..., 2], c[..., 2], c[..., 3] + c[..., 2]], -1))


def undo_palette(argb: np.ndarray, palette: np.ndarray, packed: int, width: int) -> np.ndarray:
    """packed: binary logarithm of the pixels that share one index pixel."""
    index = argb >> 8 & 255
    if packed:
        each = 8 >> packed
        index = np.stack([index >> np.uint32(each * k) & np.uint32((1 << each) - 1) for k in range(1 << packed)], -1).reshape(argb.shape[0], -1)[:, :width]
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], 0).astype(np.uint32)


class Image:
    """A lossless WebP file, parsed up to its pixels."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("not a WebP file")
        at = 12
        while data[at : at + 4] != b"VP8L":
            if at + 8 > len(data):
                raise ValueError("not a lossless WebP file")
            size = struct.unpack_from("<I", data, at + 4)[0]
            at += 8 + size + (size & 1)
        size = struct.unpack_from("<I", data, at + 4)[0]
        self.data = data[at + 8 : at + 8 + size]
        bits = BitReader(self.data)
        if bits.read(8) != 0x2F:
            raise ValueError("no lossless signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)  # a hint about alpha
        if bits.read(3):
            raise ValueError("unknown version")
        self.undo, width, seen = [], self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise ValueError("a transform comes twice")
            seen.add(kind)
            if kind < 2:
                size = bits.read(3) + 2
                blocks = Stream(bits, -(-width >> size), -(-self.height >> size), False).pixels()
                self.undo.append((lambda p, b=blocks, s=size: undo_predictor(p, (b >> 8 & 15).astype(int), s)) if kind == 0 else (lambda p, b=blocks, s=size: undo_cross_colour(p, b, s)))
            elif kind == 2:
                self.undo.append(undo_subtract_green)
            else:
                colours = bits.read(8) + 1
                steps = _split(Stream(bits, colours, 1, False).pixels()[0])
                packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
                self.undo.append(lambda p, t=_join(np.cumsum(steps, 0)), k=packed, w=width: undo_palette(p, t, k, w))
                width = -(-width >> packed)
        self.stream = Stream(bits, width, self.height, True)

    def finish(self, argb: np.ndarray) -> np.ndarray:
        """Red, green, blue, height x width x 3, of the entropy-coded pixels."""
        for undo in reversed(self.undo):
            argb = undo(argb)
        return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        return self.finish(self.stream.pixels())


@lru_cache(maxsize=64)
def near_distances(width: int) -> np.ndarray:
    """Pixels back of distance codes 1 to 120, at 0 nothing."""
    return np.array([0] + [max(1, x + y * width) for x, y in NEAR])


def _value(window: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance prefixes, whose extra bits begin at `at`, and where those end."""
    more = np.maximum(prefix - 2, 0) >> 1
    extra = window.take(at >> 3, mode="clip") >> (at & 7) & ((np.int64(1) << more) - 1)
    return np.where(prefix < 4, prefix, (2 + (prefix & 1)) << more) + extra + 1, at + more


def read_together(images: list[Image]) -> list[np.ndarray]:
    """The entropy-coded pixels of images with common() streams."""
    streams = [x.stream for x in images]
    codes: dict[int, PrefixCode] = {}
    places: dict[int, int] = {}
    sets, first_set = [], []
    for x in streams:
        first_set.append(len(sets))
        for g in x.groups:
            for code in (g[0], g[1], g[2], g[4]):
                codes.setdefault(id(code), code)
            sets.append([places.setdefault(id(g[k]), len(places)) for k in (0, 1, 2, 4)])
    table = np.concatenate([c.packed(LONGEST) for c in codes.values()])
    green_at, red_at, blue_at, far_at = np.ascontiguousarray(np.array(sets).T) << LONGEST
    first_set = np.array(first_set)
    raw = np.frombuffer(b"".join(x.data + bytes(8) for x in images), np.uint8)
    begin = np.cumsum([0] + [len(x.data) + 8 for x in images])[:-1]
    window = np.zeros(len(raw), np.int64)  # the 33 bits and more from every byte on
    for k in range(5):
        window[: len(raw) - k] |= raw[k:].astype(np.int64) << 8 * k
    counts = np.array([x.width * x.height for x in streams])
    width = np.array([x.width for x in streams])
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    alpha = np.array([int(x.groups[0][3].symbols[0]) << 24 for x in streams], np.int64)
    # entropy images and caches end to end; an image without one has an entry of its own that says as much
    metas = [np.zeros((1, 1), np.int64) if x.meta is None else x.meta.astype(np.int64) for x in streams]
    shift_meta = np.array([31 if x.meta is None else x.meta_bits for x in streams])
    meta, meta_width = np.concatenate([m.ravel() for m in metas]), np.array([m.shape[1] for m in metas])
    meta_at = np.cumsum([0] + [m.size for m in metas])[:-1]
    any_meta = any(x.meta is not None for x in streams)
    cache_bits = np.array([x.cache for x in streams])
    any_cache = bool(cache_bits.any())
    cache_at = np.cumsum([0] + [1 << max(1, x) for x in cache_bits.tolist()])
    cache, shift, cache_at = np.zeros(int(cache_at[-1]), np.int64), 32 - np.maximum(cache_bits, 1), cache_at[:-1]
    slot = lambda who, value: cache_at[who] + ((0x1E35A7BD * value & 0xFFFFFFFF) >> shift[who])
    at = 8 * begin + np.array([x.bits.at for x in streams])
    who, pos, mask = np.argsort(-counts, kind="stable"), start.copy(), np.int64((1 << LONGEST) - 1)
    at, pos = at[who], pos[who]
    end = (start + counts)[who]
    last = (8 * begin + 8 * np.array([len(x.data) for x in images]))[who]

    def finish(some: np.ndarray) -> None:
        if (at[some] > last[some]).any():
            raise ValueError("an image ends early")

    while len(who) > FEW:
        of = first_set[who]
        if any_meta:
            y, x = np.divmod(pos - start[who], width[who])
            of = of + meta[meta_at[who] + (y >> shift_meta[who]) * meta_width[who] + (x >> shift_meta[who])]
        bits = window.take(at >> 3, mode="clip") >> (at & 7)  # past the end only in damaged images
        green = table[(bits & mask) + green_at[of]].astype(np.int64)
        symbol, size = green >> 4, green & 15
        bits >>= size
        red = table[(bits & mask) + red_at[of]].astype(np.int64)
        bits >>= red & 15
        blue = table[(bits & mask) + blue_at[of]].astype(np.int64)
        literal = symbol < LITERALS
        value = alpha[who] | red >> 4 << 16 | symbol << 8 | blue >> 4
        long = None
        if literal.all():
            at += size + (red & 15) + (blue & 15)
        else:
            at += size + np.where(literal, (red & 15) + (blue & 15), 0)
            cached = np.flatnonzero(symbol >= LITERALS + LENGTHS)
            value[cached] = cache[cache_at[who[cached]] + symbol[cached] - LITERALS - LENGTHS]
            long = np.flatnonzero(~literal & (symbol < LITERALS + LENGTHS))
        if long is None or not len(long):
            out[pos] = value
            if any_cache:
                cache[slot(who, value)] = value
            pos += 1
        else:
            one = np.flatnonzero(literal | (symbol >= LITERALS + LENGTHS))
            out[pos[one]] = value[one]
            if any_cache:
                cache[slot(who[one], value[one])] = value[one]
            pos[one] += 1
            length, behind = _value(window, at[long], symbol[long] - LITERALS)
            code = table[(window.take(behind >> 3, mode="clip") >> (behind & 7) & mask) + far_at[of[long]]].astype(np.int64)
            far, at[long] = _value(window, behind + (code & 15), code >> 4)
            for i, n, d in zip(long.tolist(), length.tolist(), far.tolist(), strict=True):
                w, p = int(who[i]), int(pos[i])
                back = d - len(NEAR) if d > len(NEAR) else int(near_distances(int(width[w]))[d])
                if back > p - start[w] or p + n > end[i]:
                    raise ValueError("a back-reference leaves the image")
                copied = out[p - back : p - back + n] if back >= n else np.resize(out[p - back : p], n)
                out[p : p + n] = copied
                if cache_bits[w]:
                    cache[slot(w, copied)] = copied
                pos[i] = p + n
        done = pos >= end
        if done.any():
            finish(np.flatnonzero(done))
            left = np.flatnonzero(~done)
            who, at, pos, end, last = who[left], at[left], pos[left], end[left], last[left]
    found = [out[a : a + n].astype(np.uint32).reshape(x.height, x.width) for a, n, x in zip(start.tolist(), counts.tolist(), streams, strict=True)]
    for i, w in enumerate(who.tolist()):
        streams[w].bits.at = int(at[i] - 8 * begin[w])
        found[w] = streams[w].pixels(out[start[w] : pos[i]])
    return found


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixels (height x width x 3) of each file; common streams are decoded side by side."""
    images = [Image(x) for x in files]
    together = [x for x in images if x.stream.common()]
    read = dict(zip(map(id, together), read_together(together), strict=True)) if together else {}
    return [x.finish(read[id(x)]) if id(x) in read else x.rgb() for x in images]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Huffman code lengths of at most `longest` bits; small counts are raised until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    least, own, n = max(1, int(counts.sum()) >> longest), counts[used], len(used)
    order = np.argsort(own, kind="stable")
    while True:
        # two queues: symbols by count, and joined nodes, which come in the order of their counts
        weight = np.maximum(own[order], least).tolist()
        above = [0] * (2 * n - 1)
        leaf, joined = 0, n
        for node in range(n, 2 * n - 1):
            if leaf < n and (joined >= node or weight[leaf] <= weight[joined]):
                a, leaf = leaf, leaf + 1
            else:
                a, joined = joined, joined + 1
            if leaf < n and (joined >= node or weight[leaf] <= weight[joined]):
                b, leaf = leaf, leaf + 1
            else:
                b, joined = joined, joined + 1
            above[a] = above[b] = node
            weight.append(weight[a] + weight[b])
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[above[node]] + 1
        if max(depth[:n]) <= longest:
            lengths[used[order]] = depth[:n]
            return lengths
        least = 2 * least + counts.sum() // 2048


# How code lengths are written: a fixed code for lengths and runs of zeros (17: 3 to 10, 18: 11 to 138).
_LENGTH_CODE = np.array([{4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 9: 3, 17: 4, 18: 4, 0: 5, 3: 5, 10: 5, 1: 7, 2: 7, 11: 7, 12: 7}.get(x, 0) for x in range(19)], np.uint8)
_LENGTH_WORDS = {int(x): (reverse(int(c), int(_LENGTH_CODE[x])), int(_LENGTH_CODE[x])) for x, c in zip(*canonical(_LENGTH_CODE), strict=True)}
_LENGTH_HEAD = sum(int(_LENGTH_CODE[x]) << 3 * i for i, x in enumerate(LENGTH_ORDER))


#: The lengths of the code length code that has 4 bits for each length of 0 to 15, three bits each.
_FOUR_EACH = sum(4 << 3 * i for i, symbol in enumerate(LENGTH_ORDER) if symbol < 16)


def code_bits(lengths: np.ndarray) -> tuple[int, int]:
    """A prefix code's lengths as bits and their number: the simple form for one symbol; four bits for each length up to
    the last in use, which reads fast, of bytes; else lengths and runs of zeros."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) == 1 and used[0] < 256:
        return 1 | 1 << 2 | used[0] << 3, 11
    if len(lengths) <= LITERALS + LENGTHS:
        last = max(used[-1] + 1, 2)
        wide = 3 if last < 258 else 4  # 8 or 10 bits
        nibbles = np.zeros(last + (last & 1), np.uint8)
        nibbles[:last] = _reversed[4][lengths[:last]]
        packed = int.from_bytes((nibbles[::2] | nibbles[1::2] << 4).tobytes(), "little")
        front = 15 << 1 | _FOUR_EACH << 5 | (1 | wide << 1 | last - 2 << 4) << 62
        return front | packed << (68 + 2 * wide), 68 + 2 * wide + 4 * last
    value, n = 15 << 1 | _LENGTH_HEAD << 5, 63  # lengths up to the alphabet's end
    words, zero, some, many = _LENGTH_WORDS, _LENGTH_WORDS[0], _LENGTH_WORDS[17], _LENGTH_WORDS[18]
    before = -1
    for at, size in zip([*used, len(lengths)], [*lengths[used].tolist(), None], strict=True):
        gap = at - before - 1
        while gap:
            run = min(gap, 138)
            if run >= 11:
                value |= (many[0] | run - 11 << many[1]) << n
                n += many[1] + 7
            elif run >= 3:
                value |= (some[0] | run - 3 << some[1]) << n
                n += some[1] + 3
            else:
                run = 1
                value |= zero[0] << n
                n += zero[1]
            gap -= run
        if size is not None:
            word, bits = words[size]
            value |= word << n
            n += bits
        before = at
    return value, n


def container(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def head(out: BitWriter, width: int, height: int) -> None:
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(0, 4)


def _small(out: BitWriter, argb: list[int]) -> None:
    """A stream of few pixels, as literals without cache or groups: palettes and predictor blocks."""
    out.write(0, 1)
    channels = [[p >> k & 255 for p in argb] for k in (8, 16, 0, 24)]
    words = []
    for values in channels:
        lengths = code_lengths(np.bincount(values, minlength=256))
        out.write(*code_bits(np.append(lengths, np.zeros(LENGTHS, np.uint8)) if not words else lengths))
        symbols, codes = canonical(lengths)
        lone = len(symbols) == 1
        words.append({int(x): (0, 0) if lone else (reverse(int(c), int(lengths[x])), int(lengths[x])) for x, c in zip(symbols, codes, strict=True)})
    out.write(*code_bits(np.arange(DISTANCES) == 0))
    for pixel in zip(*channels, strict=True):
        for word, value in zip(words, pixel, strict=True):
            out.write(*word[value])


def _entropy(of: np.ndarray, values: np.ndarray, images: int, width: int = 256) -> np.ndarray:
    """Bits of each image's values under their own code, with about 5 for each symbol that occurs."""
    counts = np.bincount(of * width + values, minlength=images * width).reshape(images, width).astype(np.float32)
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1) + 5 * (counts > 0).sum(1)


def _residuals(c: np.ndarray, mode: int) -> np.ndarray:
    """Channels less their prediction: from the left (1) or from above (2)."""
    out = c.copy()
    out[0, 1:] -= c[0, :-1]
    out[0, 0] -= np.array([255, 0, 0, 0], c.dtype)
    if mode == 2:
        out[1:] -= c[:-1]
    else:
        out[1:, 1:] -= c[1:, :-1]
        out[1:, 0] -= c[:-1, 0]
    return out & 255


def _transformed(argb: list[np.ndarray]) -> list[tuple[BitWriter, np.ndarray]]:
    """For each image its transforms' bits and the pixels to be coded."""
    count = len(argb)
    sizes = np.array([x.size for x in argb])
    of = np.repeat(np.arange(count), sizes)
    every = np.concatenate([x.ravel() for x in argb]).astype(np.int64)
    wide = np.array([x.shape[1] for x in argb])[of]
    place = np.arange(len(every)) - (np.cumsum(sizes) - sizes)[of]
    # costs are estimates: of a long image every fourth row counts
    some = np.flatnonzero((place // wide & 3 == 0) | (sizes <= 1024)[of])
    few, wide, place = of[some], wide[some], place[some]
    channels = lambda x: (x >> 16 & 255, x >> 8 & 255, x & 255)
    cost = lambda r, g, b: _entropy(few, g, count) + _entropy(np.concatenate([few, few]), np.concatenate([r, b]), count)
    red, green, blue = channels(every[some])
    plain = cost(red, green, blue)
    costs = [plain, cost(red - green & 255, green, blue - green & 255)]
    for mode in (1, 2):
        left = (place < wide) if mode == 2 else (place % wide > 0)
        source = channels(np.where(place > 0, every[np.maximum(some - np.where(left, 1, wide), 0)], 0))
        costs.append(cost(*((x - y) & 255 for x, y in zip((red, green, blue), source, strict=True))))
    ordered = np.sort(few << 24 | every[some] & 0xFFFFFF)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    ends = np.append(starts[1:], len(ordered))
    owner, many = ordered[starts] >> 24, (ends - starts).astype(np.float64)
    pixels = np.bincount(few, minlength=count)
    colours = np.bincount(owner, minlength=count)
    index_bits = pixels * np.log2(np.maximum(pixels, 1)) - np.bincount(owner, many * np.log2(many), count)
    costs.append(np.where(colours <= 256, index_bits + 25 * colours, np.inf))
    best = np.argmin(costs, 0)
    best[np.min(costs, 0) > (1 - SAVED) * plain] = 0
    found = []
    for i, x in enumerate(argb):
        out, kind = BitWriter(), int(best[i])
        if kind == 1:
            out.write(1 | 2 << 1, 3)
            c = _split(x)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            x = _join(c)
        elif kind in (2, 3):
            out.write(1, 3)
            out.write(BLOCK - 2, 3)
            _small(out, [255 << 24 | (kind - 1) << 8] * (-(-x.shape[0] >> BLOCK) * -(-x.shape[1] >> BLOCK)))
            x = _join(_residuals(_split(x), kind - 1))
        elif kind == 4 and len((table := np.unique(x, return_inverse=True))[0]) <= 256:
            palette, at = table
            out.write(1 | 3 << 1, 3)
            out.write(len(palette) - 1, 8)
            steps = _split(palette)
            steps[1:] -= steps[:-1].copy()
            _small(out, _join(steps).tolist())
            packed = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            across = -(-x.shape[1] >> packed)
            at = np.pad(at.reshape(x.shape), ((0, 0), (0, (across << packed) - x.shape[1]))).reshape(x.shape[0], across, 1 << packed)
            x = (255 << 24 | ((at << (8 >> packed) * np.arange(1 << packed)).sum(2) << 8)).astype(np.uint32)
        out.write(0, 1)
        found.append((out, x))
    return found


def _before(key: np.ndarray) -> np.ndarray:
    """The place of the last equal key before each one, -1 if there is none. Keys count by as many low bits as fit beside a place."""
    bits = np.int64(max(1, (len(key) - 1).bit_length()))
    ordered = np.sort(key.astype(np.int64) << bits | np.arange(len(key)))
    same = ordered[1:] >> bits == ordered[:-1] >> bits
    place = ordered & ((1 << bits) - 1)
    out = np.full(len(key), -1)
    out[place[1:][same]] = place[:-1][same]
    return out


def _matches(pixels: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the back-references, in order and apart: of each stretch that repeats the pixels at
    one distance, as much as those before have left."""
    n = len(pixels) - MATCH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    wide = pixels.astype(np.uint64)
    key = of[:n].astype(np.uint64) + np.uint64(1)
    for k in range(MATCH):
        key = (key ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    before = _before(key >> np.uint64(20))
    at = np.flatnonzero((before >= 0) & (of[:n] == of[MATCH - 1 :]))
    back = before[at]
    real = of[back] == of[at]
    for k in range(MATCH):
        real &= pixels[at + k] == pixels[back + k]
    at, back = at[real], back[real]
    if not len(at):
        return none, none, none
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (at[1:] - back[1:] != at[:-1] - back[:-1]), [True]]))
    place, length, distance, free = [], [], [], 0
    for a, z, d in zip(at[cut[:-1]].tolist(), (at[cut[1:] - 1] + MATCH).tolist(), (at - back)[cut[:-1]].tolist(), strict=True):
        a = max(a, free)
        while z - a >= MATCH:
            size = min(z - a, LONGEST_MATCH)
            place.append(a)
            length.append(size)
            distance.append(d)
            a = free = a + size
    return np.array(place, np.int64), np.array(length, np.int64), np.array(distance, np.int64)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distances."""
    v = value - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    more = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(v < 4, 0, v & ((1 << more) - 1)), more


def _far(distance: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distance codes: those of near pixels where there is one."""
    out = distance + len(NEAR)
    for w in np.unique(width).tolist():
        near = near_distances(w)
        code = np.zeros(int(near.max()) + 1, np.int64)
        code[near[:0:-1]] = np.arange(len(NEAR), 0, -1)
        some = np.flatnonzero((width == w) & (distance < len(code)))
        out[some] = np.where(code[distance[some]] > 0, code[distance[some]], out[some])
    return out


def _two_groups(green: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """A group (0 or 1) for each block, all 0 if two codes don't pay; blocks go to the nearer of the two most unlike."""
    counts = np.bincount(block * LITERALS + green, minlength=blocks * LITERALS).reshape(blocks, LITERALS) + 0.02
    bits = -np.log2(counts / counts.sum(1, keepdims=True))
    loss = counts @ bits.T  # of each block under each one's code
    loss -= np.diag(loss)[:, None].copy()
    a, b = np.unravel_index(np.argmax(loss + loss.T), loss.shape)
    chosen = (loss[:, b] < loss[:, a]).astype(np.int64)
    size = lambda c: (c * -np.log2(c / c.sum())).sum()
    if len(np.unique(chosen)) < 2 or size(counts.sum(0)) - size(counts[chosen == 0].sum(0)) - size(counts[chosen == 1].sum(0)) < GROUP_COST / 3:
        return np.zeros(blocks, np.int64)
    return chosen


def encode_all(rgbs: list[np.ndarray]) -> list[bytes]:
    """A file of each image's pixels (height x width x 3)."""
    if not rgbs:
        return []
    sizes = [x.shape[:2] for x in rgbs]
    coded = _transformed([255 << 24 | (c := x.astype(np.uint32))[..., 0] << 16 | c[..., 1] << 8 | c[..., 2] for x in rgbs])
    count = len(coded)
    pixels = np.concatenate([x.ravel() for _, x in coded]).astype(np.int64)
    each = np.array([x.size for _, x in coded])
    start = np.cumsum(each) - each
    of = np.repeat(np.arange(count), each)
    width = np.array([x.shape[1] for _, x in coded])
    place, length, distance = _matches(pixels, of)
    begins = np.zeros(len(pixels) + 1, np.int64)
    np.add.at(begins, place, 1)
    np.add.at(begins, place + length, -1)
    begins = np.cumsum(begins[:-1]) == 0
    # the colour cache holds the last pixel of each hash, whatever wrote it
    slot = (0x1E35A7BD * pixels & 0xFFFFFFFF) >> (32 - CACHE)
    before = _before(of << CACHE | slot)
    hit = begins & (before >= 0) & (pixels[before] == pixels)
    used = np.bincount(np.unique(of[hit] << CACHE | slot[hit]) >> CACHE, minlength=count)
    cached = 5 * np.bincount(of[hit], minlength=count) > 12 * used + 100
    hit &= cached[of]
    begins[place] = True
    at = np.flatnonzero(begins)
    image, p = of[at], pixels[at]
    symbol = np.where(hit[at], LITERALS + LENGTHS + slot[at], p >> 8 & 255)
    reference = np.searchsorted(at, place)
    more_value, more_bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    prefix, more_value[reference], more_bits[reference] = _prefixed(length)
    symbol[reference] = LITERALS + prefix
    literal = symbol < LITERALS
    far, far_value, far_bits = _prefixed(_far(distance, width[of[place]]))
    # a second code group for long images whose blocks differ
    metas: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    side = 1 << BLOCK
    for i in np.flatnonzero(each > 2 * side * side).tolist():
        some = np.flatnonzero(image == i)
        y, x = np.divmod(at[some] - start[i], width[i])
        wide = -(-int(width[i]) >> BLOCK)
        block = (y >> BLOCK) * wide + (x >> BLOCK)
        plain = literal[some]
        blocks = wide * -(-(int(each[i]) // int(width[i])) >> BLOCK)
        chosen = _two_groups(symbol[some][plain], block[plain], blocks)
        if chosen.any():
            metas[i] = (chosen, some[chosen[block] == 1])
    owner = image.copy()
    for k, (_, some) in enumerate(metas.values()):
        owner[some] = count + k
    total, greens = count + len(metas), LITERALS + LENGTHS + (1 << CACHE)
    lits = np.flatnonzero(literal)
    of_green = np.bincount(owner * greens + symbol, minlength=total * greens).reshape(total, greens)
    of_rest = np.bincount(owner[lits] * 256 + (p[lits] >> 16 & 255), minlength=total * 256).reshape(total, 256)
    of_blue = np.bincount(owner[lits] * 256 + (p[lits] & 255), minlength=total * 256).reshape(total, 256)
    of_far = np.bincount(owner[reference] * DISTANCES + far, minlength=total * DISTANCES).reshape(total, DISTANCES)
    lone = ((of_rest > 0).sum(1) < 2) | ((of_blue > 0).sum(1) < 2)  # red and blue have a code each, else one for both
    both = of_rest + of_blue
    tables = [(np.zeros((total, n), np.int64), np.zeros((total, n), np.int64)) for n in (greens, 256, 256, DISTANCES)]
    heads: list[list[tuple[int, int]]] = []
    for i in range(total):
        row: list[tuple[int, int]] = []
        for k, counts in enumerate((of_green[i], of_rest[i] if lone[i] else both[i], of_blue[i] if lone[i] else both[i], of_far[i])):
            if k == 2 and not lone[i]:
                row.append(row[1])
                tables[2][0][i], tables[2][1][i] = tables[1][0][i], tables[1][1][i]
                continue
            lengths = code_lengths(counts) if counts.any() else (np.arange(len(counts)) == 0).astype(np.uint8)
            symbols, codes = canonical(lengths)
            if len(symbols) > 1:
                size = lengths[symbols].astype(np.int64)
                tables[k][0][i, symbols] = size
                tables[k][1][i, symbols] = _reversed[LONGEST][codes << (LONGEST - size)]
            row.append(code_bits(lengths if k or cached[i if i < count else list(metas)[i - count]] else lengths[: LITERALS + LENGTHS]))
        heads.append(row)
    second = {i: count + k for k, i in enumerate(metas)}
    alphas = [int(x.flat[0]) >> 24 for _, x in coded]
    starts_of, fronts = [], []
    for i, ((transforms, x), (tall, wide)) in enumerate(zip(coded, sizes, strict=True)):
        out = BitWriter()
        head(out, wide, tall)
        out.write(transforms.value, transforms.n)
        out.write(*((1 | CACHE << 1, 5) if cached[i] else (0, 1)))
        if i in second:
            out.write(1, 1)
            out.write(BLOCK - 2, 3)
            _small(out, [255 << 24 | int(g) << 8 for g in metas[i][0]])
        else:
            out.write(0, 1)
        for g in (i, second[i]) if i in second else (i,):
            green, red, blue, far_code = heads[g]
            for code in (green, red, blue, code_bits(np.arange(256) == alphas[i]), far_code):
                out.write(*code)
        fronts.append(out)
    # A symbol's bits are one value of up to 30 bits, those of a distance another; what begins in one 32-bit word is added up.
    sized, worded = zip(*tables, strict=True)
    bits_of = sized[0][owner, symbol]
    value = worded[0][owner, symbol]
    red, blue = p[lits] >> 16 & 255, p[lits] & 255
    value[lits] |= worded[1][owner[lits], red] << bits_of[lits]
    bits_of[lits] += sized[1][owner[lits], red]
    value[lits] |= worded[2][owner[lits], blue] << bits_of[lits]
    bits_of[lits] += sized[2][owner[lits], blue]
    value |= more_value << bits_of
    bits_of += more_bits
    far_size = sized[3][owner[reference], far]
    item = np.arange(len(at))
    item += np.searchsorted(reference, item, "left")  # each distance is an item after its length
    values, lengths = np.zeros(len(at) + len(reference), np.int64), np.zeros(len(at) + len(reference), np.int64)
    values[item], lengths[item] = value, bits_of
    after = item[reference] + 1
    values[after], lengths[after] = worded[3][owner[reference], far] | far_value << far_size, far_size + far_bits
    own = np.zeros(len(values), np.int64)
    own[item], own[after] = image, image[reference]
    stream = np.bincount(own, lengths, count).astype(np.int64)
    front = np.array([x.n for x in fronts])
    room = (front + stream + 31) // 32 + 2
    base = 32 * (np.cumsum(room) - room)
    ends = np.cumsum(lengths)
    begin = ends - lengths - (np.cumsum(stream) - stream)[own] + front[own] + base[own]
    words = np.zeros(int(room.sum()) + 2, np.int64)
    for x, b in zip(fronts, (base // 32).tolist(), strict=True):
        lead = np.frombuffer(x.value.to_bytes((x.n + 31) // 32 * 4, "little"), "<u4")
        words[b : b + len(lead)] = lead
    word, shifted = begin >> 5, values << (begin & 31)
    group = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[group]] += np.add.reduceat(shifted & 0xFFFFFFFF, group)
    words[word[group] + 1] += np.add.reduceat(shifted >> 32, group)
    raw = words.astype("<u4").tobytes()
    return [container(raw[b // 8 : b // 8 + (n + 7) // 8]) for b, n in zip(base.tolist(), (front + stream).tolist(), strict=True)]


def encode(rgb: np.ndarray) -> bytes:
    """A file of one image's pixels (height x width x 3)."""
    return encode_all([rgb])[0]


def pixels_of(payload: bytes) -> np.ndarray:
    """The image of a payload, a positive multiple of ROW bytes."""
    rows = len(payload) // ROW
    wide = -(-rows // MOST_ROWS)
    tall = -(-rows // wide)
    return np.frombuffer(payload + bytes(wide * tall * ROW - len(payload)), np.uint8).reshape(tall, wide * WIDTH, 3)


def padded(text: bytes) -> bytes:
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def describe(rgb: np.ndarray) -> str:
    """Shape, mean of each colour, and 64 bits of which stretches of the image are greener than the mean."""
    flat = rgb.reshape(-1, 3)
    means = flat.sum(0, dtype=np.int64) / len(flat)
    edges = len(flat) * np.arange(65) // 64
    sums = np.add.reduceat(flat[:, 1], edges[:-1], dtype=np.int64)
    green = sums > means[1] * np.diff(edges)
    return f"{rgb.shape[1]}x{rgb.shape[0]};{means[0]:.2f},{means[1]:.2f},{means[2]:.2f};{np.packbits(green).tobytes().hex()}"


def store(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_bytes, payload_bytes and media, the text's padded bytes as a WebP file."""
    n = len(keep)
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() for x in batch.column(n).to_pylist()]
            payloads = [padded(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array(encode_all([pixels_of(x) for x in payloads]), pa.binary())],
                [*batch.schema.names[:n], "n_bytes", "payload_bytes", "media"],
            )

    kept = ", ".join(f"_keep{i} {rows.schema[i].dataType.simpleString()}" for i in range(n))
    out = rows.mapInArrow(run, f"{kept}, n_bytes long, payload_bytes long, media binary")
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "payload_bytes", "media")


def read(stored: DataFrame) -> DataFrame:
    """stored with width, height, payload (the pixels' bytes, as many as payload_bytes) and feature."""
    added = ["width", "height", "payload", "feature"]

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        images = decode(batch.column("media").to_pylist())
        lengths = batch.column("payload_bytes").to_pylist()
        arrays = [pa.array([x.shape[1] for x in images], pa.int32()), pa.array([x.shape[0] for x in images], pa.int32()), pa.array([x.tobytes()[:m] for x, m in zip(images, lengths, strict=True)], pa.binary()), pa.array([describe(x) for x in images], pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.column("media").nbytes
            if rows >= TOGETHER or size >= TOGETHER_BYTES:
                yield finish(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, rows, size = [], 0, 0
        if rows:
            yield finish(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInArrow(run, f"{fields}, width int, height int, payload binary, feature string")
