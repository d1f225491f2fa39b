"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into classes (c/2, c],
c a power of two. For each class a document is cut into segments of 2c
shingles, one each c, so that a copy of an item of the class lies whole in one
of them, however long the document is; in a segment the item's Jaccard
similarity is bounded below, and `registers` minima find it: at least one is
shared except with probability (1 - J)^registers, 1.4e-6 for an item of which
`threshold` 0.8 is there, at the worst size of its class (0.4c of 2.1c). Items
of at most SMALL shingles are looked up exactly instead, by their rarest shingles
alone: of those that may be missing and one more, a document that contains the
item has one. Segment minima are
minima of block minima, so all classes together cost little more than one.
Each candidate is verified by exact containment: the share of the item's
distinct shingles that the whole document has.

Spark computes each item's shingles and minima once; the documents are never
shuffled: items go to them in blocks of at most about `block_bytes`, one scan
for each block, so that what is broadcast is bounded whatever the number and
length of items. A worker puts a block in order once, for all its tasks.

Defined results: null and empty texts, and items without words, meet nothing;
an item of fewer words than a shingle is one shingle, compared with shingles
of that many words; items of equal text are reported each; rows with null
doc_id or item_id are kept with null; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import hashing as hs
from almanac.llm.shingles import distinct, shingled
from almanac.session import materialize, read

SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
U64 = hs.U64
SMALL = 8


@np.errstate(over="ignore")
def described(items: DataFrame, k: int, registers: int) -> DataFrame:
    """(item_id, width, shingles, minima) of items that have words: shingle
    width, distinct shingles in order, and the least of each register."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                words = len((text or "").encode().split())
                if not words:
                    continue
                _, _, h, _ = next(iter(shingled(pa.array([text], pa.string()), min(k, words))))
                h = np.unique(h)
                least = np.asarray([hs.permuted(h, j).min() for j in range(registers)], U64) if len(h) > SMALL else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([min(k, words)], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["item_id", "width", "shingles", "minima"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(rows, "item_id long, width int, shingles binary, minima binary")


class Items:
    """A block of described items: for each class, register minima in order
    with their items; for small items, by width, the shingles that they are looked
    up by in order with theirs; and each item's distinct shingles."""

    def __init__(self, ids: list, widths: list, shingles: list, minima: list, registers: int, threshold: float):
        self.registers, self.ids = registers, ids
        self.sets = [np.frombuffer(x, U64) for x in shingles]
        classes: dict[tuple[int, int], list[int]] = {}
        small: dict[int, list[int]] = {}
        for i, (width, s) in enumerate(zip(widths, self.sets, strict=True)):
            if len(s) <= SMALL:
                small.setdefault(width, []).append(i)
            else:
                classes.setdefault((width, 1 << int(len(s) - 1).bit_length()), []).append(i)
        self.small = {w: self.table(*self.rarest(of, threshold)) for w, of in small.items()}
        self.classes = {}
        for key, of in classes.items():
            least = np.stack([np.frombuffer(minima[i], U64) for i in of])
            self.classes[key] = [self.table(least[:, j], np.asarray(of)) for j in range(registers)]

    def rarest(self, of: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each small item as many shingles as may be missing and one more,
        those that the fewest of these items have; and their items."""
        shingle = np.concatenate([self.sets[i] for i in of])
        item = np.repeat(of, [len(self.sets[i]) for i in of])
        _, which, n = np.unique(shingle, return_inverse=True, return_counts=True)
        size = np.asarray([len(self.sets[i]) for i in of])
        kept = np.repeat(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, size)
        order = np.lexsort((shingle, n[which], np.repeat(np.arange(len(of)), size)))
        place = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        take = order[place < kept]
        return shingle[take], item[take]

    @staticmethod
    def table(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, their items, and which last 16 bits occur."""
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << 16, bool)
        bits[(keys & U64(0xFFFF)).astype(np.int64)] = True
        return keys[order], items[order], bits

    def small_candidates(self, h: np.ndarray, offs: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(document, item) of small items of which one of these shingles is there."""
        if width not in self.small or not len(h):
            return set()
        keys, items, bits = self.small[width]
        at = np.flatnonzero(bits[(h & U64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        n = hi - lo
        doc = np.searchsorted(offs, np.repeat(at, n), "right") - 1
        item = items[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        both = np.unique(doc * len(self.sets) + item)
        return set(zip((both // len(self.sets)).tolist(), (both % len(self.sets)).tolist(), strict=True))

    @np.errstate(over="ignore")
    def candidates(self, h: np.ndarray, offs: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(document, item) of items of that shingle width."""
        sizes = sorted(c for w, c in self.classes if w == width)
        if not sizes or not len(h):
            return set()
        base = sizes[0]
        found: set[tuple[int, int]] = set()
        n = np.diff(offs)
        blocks = -(-n // base)
        doc = np.repeat(np.arange(len(n)), blocks)
        ends = np.cumsum(blocks)
        within = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
        starts = np.repeat(offs[:-1], blocks) + within * base
        plans = {}
        for c in sizes:  # blocks of c from blocks of base, then pairs of them
            lead = np.flatnonzero(within % (c // base) == 0)
            last = np.ones(len(lead), bool)
            last[:-1] = doc[lead][1:] != doc[lead][:-1]
            plans[c] = (lead, last, doc[lead])
        for j in range(self.registers):
            least = np.minimum.reduceat(hs.permuted(h, j), starts)
            for c in sizes:
                lead, last, of = plans[c]
                m = np.minimum.reduceat(least, lead) if c > base else least
                pair = m.copy()
                np.minimum(m[:-1], m[1:], out=pair[:-1], where=~last[:-1])
                keys, items, bits = self.classes[width, c][j]
                maybe = np.flatnonzero(bits[(pair & U64(0xFFFF)).astype(np.int64)])
                if not len(maybe):
                    continue
                lo, hi = np.searchsorted(keys, pair[maybe], "left"), np.searchsorted(keys, pair[maybe], "right")
                for s in np.flatnonzero(hi > lo):
                    found.update((int(of[maybe[s]]), int(i)) for i in items[lo[s] : hi[s]])
        return found

    def search(self, ids: pa.Array, texts: pa.Array, threshold: float) -> list[tuple]:
        out = []
        for width in sorted({w for w, _ in self.classes} | set(self.small)):
            for lo, _hi, h, offs in shingled(texts, width, 1 << 20):
                found = self.candidates(h, offs, width) | self.small_candidates(h, offs, width)
                sets: dict[int, np.ndarray] = {}
                for d, i in sorted(found):
                    if d not in sets:
                        sets[d] = np.unique(h[offs[d] : offs[d + 1]])
                    item = self.sets[i]
                    at = np.minimum(np.searchsorted(sets[d], item), len(sets[d]) - 1)
                    shared = int((sets[d][at] == item).sum())
                    if shared >= threshold * len(item):
                        out.append((ids[lo + d].as_py(), self.ids[i], len(item), shared, shared / len(item)))
        return out


_HELD: dict[str, Items] = {}


class Block:
    """A broadcast block of items; held in order by each worker that asks."""

    def __init__(self, spark: SparkSession, rows: list, registers: int, threshold: float):
        self.name, self.registers, self.threshold = uuid.uuid4().hex, registers, threshold
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        self.sent = spark.sparkContext.broadcast(columns)

    def index(self) -> Items:
        if self.name not in _HELD:
            while len(_HELD) > 1:  # the last two blocks
                _HELD.pop(next(iter(_HELD)))
            _HELD[self.name] = Items(*self.sent.value, self.registers, self.threshold)
        return _HELD[self.name]


def blocks(items: DataFrame, k: int, registers: int, block_bytes: int, threshold: float) -> Iterator[Block]:
    """The items, described once and dealt by hash into blocks of at most about
    block_bytes each."""
    spark = items.sparkSession
    known = materialize(described(items, k, registers), "items")
    size = known.agg(F.sum(F.octet_length("shingles") + F.octet_length("minima") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        yield Block(spark, known.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(n)) == b).collect(), registers, threshold)


def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, registers: int = 64, block_bytes: int = 64 << 20) -> DataFrame:
    """One row for each document and item of which the document holds at least
    `threshold` of the distinct k-word shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for block in blocks(items, k, registers, block_bytes, threshold):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = block.index()
            for batch in batches:
                got = index.search(batch.column(0), batch.column(1), threshold)
                cols = list(zip(*got, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found.append(rows.mapInArrow(search, SCHEMA))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, registers: int = 64, block_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs that contain no item, all columns kept; one filter
    after another for each block of items, without a shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in blocks(items, k, registers, block_bytes, threshold):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = block.index()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                got = index.search(pa.array(range(b.num_rows)), b.column(at).cast(pa.string()), threshold)
                keep[[row for row, *_ in got]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs


def op10_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
