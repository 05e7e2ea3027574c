"""Numpy over the bytes of a batch of texts: words, sentences and their 64-bit hashes, hashed n-gram counts.

Everything here works on one Arrow column inside a task and on whole texts. A word's hash is a polynomial over its
bytes modulo 2^64, taken as a difference of running sums, so its cost is a few passes over the bytes however many
words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is a slice of its own.
SLICE = 1 << 18
_U = np.uint64
_BASE, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: Bytes that end words: white space only, or everything in ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their low and high bits depend on all bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _powers_up_to(n: int, inverse: bool) -> np.ndarray:
    factors = np.full(n, _U(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE, _U)
    factors[0] = _U(1)
    return np.cumprod(factors, dtype=_U)


@lru_cache(maxsize=2)
def _common_powers(inverse: bool) -> np.ndarray:
    return _powers_up_to(SLICE, inverse)


def _power(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the base; those for longer texts than a slice aren't held."""
    return _common_powers(inverse)[:n] if n <= SLICE else _powers_up_to(n, inverse)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets between them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of runs of texts of about `most` bytes, at least one text each."""
    data, offsets = buffer(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; the ends of texts end runs too."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    following = np.empty(n, bool)
    following[-1] = False
    following[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~following | cut[1:])) + 1
    return starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; it depends on the bytes alone. Spans may not be empty."""
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(len(data), False), dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(len(data), True)[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, ends_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the words, A-Z lower-cased; bounds[i]:bounds[i + 1] are text i's words."""
    folded = LOWER[data]
    starts, ends = spans(~ends_words[folded], offsets)
    return hashes(folded, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def chained(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` values, in order; shorter input gives none."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(length):
        total += values[k : k + n] * _power(length + 1, False)[k + 1]
    return mix(total)


def rolled(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` values, in order, at one cost for every length; shorter input gives none."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * _power(len(values), False), dtype=_U)])
    return mix((sums[length:] - sums[:n]) * _power(len(values), True)[:n])


def ngram_counts(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts (texts x 2^bits, float32) of the byte n-grams of each order, A-Z as they are, hashed to 2^bits columns."""
    texts, width = len(offsets) - 1, 1 << bits
    out = np.zeros((texts, width), np.float32)
    of_text = np.repeat(np.arange(texts, dtype=np.int64) << bits, np.diff(offsets))
    wide = data.astype(np.uint32)
    for order in orders:
        n = len(data) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, np.uint32)
        for k in range(order):
            key = key * np.uint32(0x01000193) + wide[k : k + n]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        whole = of_text[:n] == of_text[order - 1 :]
        out += np.bincount((of_text[:n] + key)[whole], minlength=texts * width).reshape(texts, width)
    return out
