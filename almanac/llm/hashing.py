"""Words and their 64-bit hashes for whole Arrow batches, by numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions
work on slices of a batch: some documents' bytes side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _table(fold: bool, rng) -> np.ndarray:
    t = rng.integers(1, 2**64 - 1, 256, dtype=U64)
    t[SPACE] = 0
    if fold:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


TABLES = {(fold, seed): _table(fold, np.random.default_rng(7919 * seed + 1)) for fold in (False, True) for seed in (0, 1)}
MULTIPLIER = {0: U64(0x9E3779B97F4A7C15), 1: U64(0xC2B2AE3D27D4EB4F)}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: each input bit changes about half of the output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _order(j: int) -> tuple[np.uint64, np.uint64]:
    a, b = np.random.default_rng(1009 + j).integers(1, 2**63, 2, dtype=np.uint64)
    return a | U64(1), b


@np.errstate(over="ignore")
def permuted(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th of many orders of hashes, for minima."""
    a, b = _order(j)
    x = (h ^ b) * a
    return x ^ (x >> U64(29))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `size`
    bytes; a longer text is a run of its own. Null texts have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (one more
    entry than documents). between: by byte, what separates words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(w), bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty(len(w), bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word. fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    longest = int((ends - starts).max())
    powers = np.ones(longest, U64)
    powers[1:] = MULTIPLIER[seed]
    powers = np.cumprod(powers, dtype=U64)
    first = starts[0]
    gaps = np.diff(starts, append=len(data))
    local = np.arange(first, len(data)) - np.repeat(starts, gaps)
    np.minimum(local, longest - 1, out=local)
    sums = np.zeros(len(data) - first + 1, U64)
    np.cumsum(TABLES[fold, seed][data[first:]] * powers[local], out=sums[1:])
    h = sums[ends - first] - sums[starts - first]
    return mix(h + (ends - starts).astype(U64) * MULTIPLIER[1 - seed])


@np.errstate(over="ignore")
def rolling(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k values side by side, by doubling."""
    if len(x) < k:
        return x[:0]
    out, done, part, width, power = None, 0, x, 1, MULTIPLIER[seed]
    powers = {1: power}
    while True:
        if k >> (width.bit_length() - 1) & 1:
            if out is None:
                out, done = part, width
            else:
                n = len(x) - done - width + 1
                out, done = out[:n] * powers[width] + part[done : done + n], done + width
        if done == k:
            return mix(out)
        n = len(x) - 2 * width + 1
        part = part[:n] * powers[width] + part[width : width + n]
        powers[2 * width] = powers[width] * powers[width]
        width *= 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values side by side."""
    if len(x) < k:
        return x[:0]
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = k - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
