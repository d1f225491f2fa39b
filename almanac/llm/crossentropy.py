"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background, share one
vocabulary: all words of the background (A-Z as a-z), one class for others,
and a start mark; `most_words`, where given, leaves only the most frequent
words and puts the rest into the class of others. Counts are exact, of words
and of pairs, over all documents. The models are matched: the background's
counts are scaled to the target's number of tokens, and both have the same
order and smoothing,

    p(w|v) = a c(v,w)/c(v) + (1-a) p(w),  a = c(v)/(c(v)+history),
    p(w) = (c(w)+add)/(tokens+add*vocabulary)

A document's score is the mean difference of its tokens' losses, background
less target: higher is more like the target. With leave_out, a document's own
counts are taken out of each model that counted them before it is scored, so
that members of the target are scored as unseen texts are; what its copies add
stays.

Nothing of the models comes to the driver but three sums. Documents are cut
into chunks of some megabytes, which are written; each chunk gives its
distinct keys (a word, a history or a pair, as 64-bit hashes) with their
counts to buckets by key, whose number grows with the input; a bucket adds
them up and gives each chunk the counts of its keys, as a written table that
is joined to the chunks. A key reaches its bucket once for each chunk, however
frequent it is, so no task holds more than others.

Defined results: a document without words has 0 tokens, losses and score 0;
without a target corpus its model is the uniform one; null doc_ids are kept,
and are in no target; repeated rows are counted and scored as often as they
occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import hashing as hs
from almanac.session import materialize, read, sized

U64 = hs.U64
#: What stands for the class of other words and for the start of a document.
OTHER, START = U64(1), U64(0)
CHUNK_BYTES = 5 << 20
#: Bytes of text whose keys make a bucket.
BUCKET_BYTES = 10 << 20
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, times) of the words of (text) rows."""
    for b in batches:
        for _lo, _hi, data, offs in hs.slices(b.column(0), 8 << 20):
            starts, ends, _ = hs.words(data, offs)
            word, n = np.unique(hs.word_hashes(data, starts, ends, True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "times"])


@dataclass
class Shape:
    """A bounded vocabulary: hashes in order, the class of other words and the
    start mark."""

    words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + 2


def vocabulary(docs: DataFrame, most_words: int) -> Shape:
    """The most frequent words."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(counted, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    top = counts.orderBy(F.desc("times"), "word").limit(most_words).select("word").toArrow()
    return Shape(np.sort(top["word"].to_numpy().astype(np.int64).view(U64)))


# ---------------------------------------------------------------- packing
def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers, as many bytes of each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(pa.decompress(blob[1:], n * width, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(U64, copy=False)


# --------------------------------------------------------------- counting
def chunks(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(chunk, size, ids, wanted, ends, text): one row for each few megabytes
    of documents; ends are offsets into the text, which is compressed."""
    marked = target.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sized(marked), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            ids, wanted = (t.column(k).combine_chunks() for k in (0, 2))
            for lo, hi, data, offs in hs.slices(t.column(1), 2 * CHUNK_BYTES):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids[lo:hi], wanted[lo:hi], pa.array(offs))]
                text = pa.compress(np.ascontiguousarray(data).tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([len(data)]), *lists, pa.array([text], pa.binary())], ["chunk", "size", "ids", "wanted", "ends", "text"])
                made += 1

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.nbytes
            if n >= CHUNK_BYTES:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    return rows.mapInArrow(cut, "chunk long, size long, ids array<long>, wanted array<boolean>, ends array<long>, text binary")


def keyed(size: int, ends: np.ndarray, text: bytes, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the tokens of a chunk - all words', then all histories',
    then all pairs', told apart by the last two bits - and each token's
    document. known: the words that are not in the class of others, if any is."""
    data = np.frombuffer(pa.decompress(text, size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    starts, stops, first = hs.words(data, ends)
    h = hs.word_hashes(data, starts, stops, True)
    if known is not None:
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        h = np.where(known[at] == h, h, OTHER) if len(known) else np.full(len(h), OTHER)
    n = np.diff(first)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][n > 0]] = START
    with np.errstate(over="ignore"):
        kinds = [hs.mix(h), hs.mix(before), hs.mix(hs.mix(before) * hs.MULTIPLIER[0] + h)]
    out = np.concatenate([(k & ~U64(3)) | U64(i) for i, k in enumerate(kinds)])
    return out, np.repeat(np.arange(len(n)), n)


def counts(cut: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(chunk, bucket, n, target, background, words, target_tokens, tokens):
    for the n keys of each chunk in each bucket, in order, their counts over
    all documents; the last three are a bucket's own, on one of its rows."""
    size = cut.agg(F.sum("size")).first()[0] or 0
    bits = max(0, -(-size // BUCKET_BYTES) - 1).bit_length()
    sent = cut.sparkSession.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                wanted, ends = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                keys, doc = keyed(b.column(1)[i].as_py(), ends, b.column(4)[i].as_py(), sent.value)
                key, n = np.unique(keys, return_counts=True)
                mine, m = np.unique(keys[np.tile(wanted.astype(bool)[doc], 3)], return_counts=True)
                of = np.zeros(len(key), np.int64)
                of[np.searchsorted(key, mine)] = m
                del keys, doc, mine, m
                bucket = (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                cols = [[], [], [], [], []]
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    lo, hi = edge[k], edge[k + 1]
                    base = U64(k << (64 - bits)) if bits else U64(0)
                    for c, v in zip(cols, (k, int(hi - lo), packed(np.diff(key[lo:hi], prepend=base)), packed(of[lo:hi]), packed(n[lo:hi])), strict=True):
                        c.append(v)
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(cols[0])), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["chunk", "bucket", "n", "keys", "target", "background"])

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        base = U64(k << (64 - bits)) if bits else U64(0)
        ns = t["n"].to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x.as_py(), n), dtype=U64) + base for x, n in zip(t["keys"], ns, strict=True)])
        key_, at = np.unique(keys, return_inverse=True)
        del keys
        at = at.astype(np.int32)
        word, sums, back = (key_ & U64(3)) == 0, [], []
        for name in ("target", "background"):
            own = np.concatenate([unpacked(x.as_py(), n) for x, n in zip(t[name], ns, strict=True)])
            s = np.bincount(at, own, len(key_)).astype(np.int64)
            sums.append(int(s[word].sum()))
            back.append([packed(x) for x in np.split(s[at], np.cumsum(ns)[:-1])])
        rest = [0] * (len(ns) - 1)
        once = [pa.array([x, *rest], pa.int64()) for x in (int(word.sum()), *sums)]
        return pa.Table.from_arrays([t["chunk"], t["bucket"], t["n"], pa.array(back[0], pa.binary()), pa.array(back[1], pa.binary()), *once], ["chunk", "bucket", "n", "target", "background", "words", "target_tokens", "tokens"])

    given = cut.select("chunk", "size", "wanted", "ends", "text").mapInArrow(emit, "chunk long, bucket int, n int, keys binary, target binary, background binary")
    return given.groupBy("bucket").applyInArrow(add_up, "chunk long, bucket int, n int, target binary, background binary, words long, target_tokens long, tokens long")


# ---------------------------------------------------------------- scoring
def occurrences(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its own document."""
    if not len(at):
        return np.zeros(0, np.int64)
    _, place, n = np.unique(doc * (int(at.max()) + 1) + at, return_inverse=True, return_counts=True)
    return n.astype(np.int32)[place]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, most_words: int | None = None, add: float = 0.5, history: float = 50.0, leave_out: bool = False) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each row;
    losses are means over tokens, in nats."""
    known = None if most_words is None else vocabulary(docs, most_words).words
    cut = materialize(chunks(docs, target), "chunks")
    table = materialize(counts(cut, known), "counts")
    words, *tokens = (x or 0 for x in table.agg(F.sum("words"), F.sum("target_tokens"), F.sum("tokens")).first())
    size = (words if known is None else len(known)) + 2
    scales = (1.0, tokens[0] / tokens[1] if tokens[0] and tokens[1] else 1.0)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        ends = left["ends"][0].values.to_numpy()
        keys, doc = keyed(left["size"][0].as_py(), ends, left["text"][0].as_py(), sent.value)
        key, at = np.unique(keys, return_inverse=True)
        del keys
        right = right.sort_by("bucket")
        w, v, vw = np.split(at, 3)
        n = np.bincount(doc, minlength=len(ends) - 1)
        wanted = left["wanted"][0].values.to_numpy(zero_copy_only=False).astype(bool)
        own = [occurrences(x, doc) if leave_out else 0 for x in (w, v, vw)]
        loss = np.zeros((2, len(n)))
        for k, name in enumerate(("target", "background")):
            if not len(key):
                break
            c = np.concatenate([unpacked(x.as_py(), m) for x, m in zip(right[name], right["n"].to_pylist(), strict=True)]) * scales[k]
            if len(c) != len(key):
                raise ValueError(f"{len(c)} counts for {len(key)} keys")
            counted = wanted[doc] * scales[k] if k == 0 else scales[k]
            cw, cv, cvw = (np.maximum(c[x] - o * counted, 0) for x, o in zip((w, v, vw), own, strict=True))
            rest = tokens[k] * scales[k] - (n[doc] * counted if leave_out else 0)
            low = (cw + add) / (rest + add * size)
            loss[k] = np.bincount(doc, -np.log((cvw + history * low) / (cv + history)), len(n))
        loss /= np.maximum(n, 1)
        ids = left["ids"].combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(n), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[1] - loss[0])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    found = table.select("chunk", "bucket", "n", "target", "background")
    return cut.select("chunk", "size", "ids", "wanted", "ends", "text").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(rows, SCHEMA)


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that labels mark as of good quality."""
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(F.col("quality") == 1), leave_out=True)
