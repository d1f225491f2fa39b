"""Word shingles of whole texts as 64-bit hashes, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from almanac.llm import hashing as hs


@np.errstate(over="ignore")
def shingled(texts: pa.Array, k: int, size: int = hs.SLICE_BYTES, seed: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets) of runs of rows: the hashes of
    each document's k-word shingles in order, A-Z as a-z, and where each
    document's begin. A text of 1 to k-1 words is one shingle; one without
    words has none."""
    for lo, hi, data, offs in hs.slices(texts, size):
        starts, ends, first = hs.words(data, offs)
        h = hs.word_hashes(data, starts, ends, True, seed)
        count = np.diff(first)
        n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        out = np.concatenate([[0], np.cumsum(n)])
        got = np.zeros(out[-1], hs.U64)
        roll = hs.rolling(h, k, seed)
        long = np.flatnonzero(count >= k)
        at = np.arange(n[long].sum()) + np.repeat(first[long] - (np.cumsum(n[long]) - n[long]), n[long])
        to = np.arange(n[long].sum()) + np.repeat(out[long] - (np.cumsum(n[long]) - n[long]), n[long])
        got[to] = roll[at]
        for d in np.flatnonzero((count > 0) & (count < k)):
            part = h[first[d] : first[d + 1]]
            got[out[d]] = hs.rolling(part, len(part), seed)[0] + hs.U64(len(part))
        yield lo, hi, got, out


def distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order, and new offsets."""
    if not len(h):
        return h, offs
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(offs) - 1))])
