"""Rows of a block held against each other by what they share.

Spark deals rows by block and sorts them; a task reads them as a stream and holds a
few blocks at a time. How many marks two rows share is a product of matrices, for
some hundred rows against the rest of their block at once, so that what is held is
bounded and no pair is shuffled, nor built where only their number is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it reads them, pairs that it holds
#: at once, and marks that one product takes.
GATHERED, PAIRS, MARKS = 512, 1 << 20, 512


def dealt(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Rows by block, in order. What a block costs grows with its square, so that
    blocks are dealt to all tasks and not joined by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *order)


def spread(sizes: DataFrame, by: list[str], piece: int) -> DataFrame | None:
    """(by, _of) of the blocks of sizes (by, count) with more than piece rows, and
    how many parts they are dealt in; None if there is no such block."""
    large = sizes.where(F.col("count") > piece).select(*by, F.ceil(F.col("count") / piece).cast("int").alias("_of"))
    return None if large.isEmpty() else large


def differs(column: pa.Array) -> np.ndarray:
    """Whether each value is another than the one before it; nulls are alike."""
    other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[True], other | (null[1:] != null[:-1])])


def blocks(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, with the number of each row's block."""
    held, n, ends, last = [], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.logical_or.reduce([differs(batch.column(k)) for k in by])
        now = [batch.column(k)[0].as_py() for k in by]
        begins[0] = now != last
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in by]
        if begins.any():
            ends = n + int(np.flatnonzero(begins)[-1])
        held.append((batch, begins))
        n += batch.num_rows
        if ends >= GATHERED:
            table, starts = pa.Table.from_batches([b for b, _ in held]), np.concatenate([s for _, s in held])
            yield table.slice(0, ends), np.cumsum(starts[:ends])
            cut = ends - (n - batch.num_rows)  # the last block began in this batch
            held, n, ends = [(batch.slice(cut), begins[cut:])], n - ends, 0
    if held:
        yield pa.Table.from_batches([b for b, _ in held]), np.cumsum(np.concatenate([s for _, s in held]))


class Marks:
    """Lists of a column as codes: those of row i are codes[at[i] : at[i + 1]]."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        lists = pa.concat_arrays(column.chunks)
        coded = lists.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.n = len(coded.dictionary)

    def told(self, i: int) -> bytes:
        return self.codes[self.at[i] : self.at[i + 1]].tobytes()

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, code) of the marks of rows[i]."""
        size = self.at[rows + 1] - self.at[rows]
        i = np.repeat(np.arange(len(rows)), size)
        first = np.repeat(self.at[rows] - np.cumsum(size) + size, size)
        return i, self.codes[first + np.arange(len(i))]


def shared(marks: Marks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many marks each of the rows a shares with each of the rows b. Those that
    many have are counted by products of matrices, the rest one by one."""
    (ia, ca), (ib, cb) = marks.of(a), marks.of(b)
    times = np.bincount(ca, minlength=marks.n) * np.bincount(cb, minlength=marks.n)
    common = np.flatnonzero(times)
    common = common[np.argsort(-times[common], kind="stable")]
    place = np.full(marks.n, len(common))
    place[common] = np.arange(len(common))
    pa_, pb_ = place[ca], place[cb]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(common), MARKS):
        some = common[low : low + MARKS]
        if low and times[some].sum() * 8 < out.size:
            one, other = (pa_ >= low) & (pa_ < len(common)), (pb_ >= low) & (pb_ < len(common))
            order = np.argsort(pb_[other], kind="stable")
            rows, keys = ib[other][order], pb_[other][order]
            first, end = np.searchsorted(keys, pa_[one]), np.searchsorted(keys, pa_[one], "right")
            size = end - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            np.add.at(out, (np.repeat(ia[one], size), rows[at]), 1)
            break
        left, right = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for to, i, p in ((left, ia, pa_), (right, ib, pb_)):
            here = (p >= low) & (p < low + len(some))
            to[i[here], p[here] - low] = 1
        out += left @ right.T
    return out


def tiles(a: np.ndarray, b: np.ndarray, most: int, size: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, from, to): at most `most` rows of a, and those of b of their
    blocks; a and b are the rows' blocks, in order. Rows of b stand for `size` each."""
    sums = np.arange(len(b) + 1) if size is None else np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(a):
        end = min(at + most, len(a))
        low, high = np.searchsorted(b, a[at]), np.searchsorted(b, a[end - 1], "right")
        end = min(end, at + max(1, PAIRS // max(1, int(sums[high] - sums[low]))))
        yield at, end, low, np.searchsorted(b, a[end - 1], "right")
        at = end
