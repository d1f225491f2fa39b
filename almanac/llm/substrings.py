"""Substring dedup on a log-structured fingerprint index.

Windows of `window` words are sampled by the least hash of their `gram`-word
pieces: equal windows choose the same piece, and windows side by side mostly
choose the same one, so about one fingerprint stands for 14 windows and none
is missed. A fingerprint row holds the piece's hash (key), which windows chose
it (at, n) and a hash of the stretch of words they cover.

The index lies in a folder of the shared store and is kept between calls; its
manifest lists what it holds. Each batch adds fingerprint rows, in files as they
come, and a run: the batch's distinct keys with their counts, counted before they
are shuffled, so that a frequent key is one row. Runs are immutable tables, all
dealt by key into the same buckets, one file sorted by key each; so a new run and
the historical ones are merge-joined as they lie, without exchange or sort, and
runs of like size are compacted in the same way. Only fingerprints are kept,
about an eighth of the text.

Keys that the new run has twice, or that history has too, are matched, and are
verified on words when the batch arrives: rows of equal key, stretch and n repeat
all their windows; where stretches differ, one row of each is looked up in its
text and its windows are compared one by one (128 bits: key and window). Each
text drops the words that repeated windows cover.

Defined results: null and empty texts have no words; texts shorter than a
window keep all; a null doc_id is kept as such; repeated rows are each other's
repeats; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import hashing as hs
from almanac.session import forget, made, materialize, read, remove, shared_dir

U64 = hs.U64
WINDOW, GRAM = 35, 10
RUN = "key long, stretch long, n int, doc long, print long, at int"
REPEATS = "doc long, print long, at int, n int"
INVERSE = U64(pow(int(hs.MULTIPLIER[0]), -1, 1 << 64))


class Stretches:
    """Hashes of any stretch of words, from prefix sums."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(h), hs.MULTIPLIER[0], U64)
            back = np.full(len(h) + 1, INVERSE, U64)
            back[:1] = 1
            self.back = np.cumprod(back, dtype=U64)
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * np.cumprod(power, dtype=U64), dtype=U64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return hs.mix((self.sums[end] - self.sums[start]) * self.back[start])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, print, text): print tells texts of a repeated doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"), text.alias("text"))


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Fingerprint rows of (doc, print, text) rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in hs.slices(b.column(2)):
                starts, ends, first = hs.words(data, offs)
                count = np.diff(first)
                if not len(count) or count.max() < window:
                    continue
                h = hs.word_hashes(data, starts, ends)
                g = hs.rolling(h, gram)
                pos = np.arange(len(g), dtype=U64)
                chosen = (hs.sliding_min((g >> U64(32) << U64(32)) | pos, window - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
                n = np.maximum(count - window + 1, 0)
                doc = np.repeat(np.arange(hi - lo), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # window starts in their document
                whole = at + first[:-1][doc]
                piece = chosen[whole]
                new = np.ones(len(piece), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
                lead = np.flatnonzero(new)
                size = np.diff(lead, append=len(piece))
                stretch = Stretches(h)(whole[lead], whole[lead] + size + window - 1)
                of = pa.array(doc[lead] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(g[piece[lead]].view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(size.astype(np.int32)), b.column(0).take(of), b.column(1).take(of), pa.array(at[lead].astype(np.int32))], ["key", "stretch", "n", "doc", "print", "at"])

    return docs.select("doc", "print", "text").mapInArrow(rows, RUN)


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket of one file is read in its order


class FingerprintIndex:
    """Immutable sorted runs of fingerprint keys, the fingerprint rows, and the
    repeated windows found so far, in a folder of the shared store. With the
    folder of an earlier index, that one goes on. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, tier: float = 4.0):
        self.spark, self.tier = spark, tier
        self.folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.state = {"version": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "rows": [], "repeats": []}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            last = spark.read.schema("version long, state string").parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
            self.state = json.loads(last["state"])

    def _commit(self) -> None:
        self.state["version"] += 1
        entry = self.spark.createDataFrame([(self.state["version"], json.dumps(self.state))], "version long, state string")
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (key LONG, times LONG) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _new_run(self, counts: DataFrame, dealt: bool = False) -> dict:
        """Write (key, times) rows. Counting has dealt them by key already, into
        as many parts as there are buckets unless the session names another
        number; and so has a join of runs."""
        name = f"almanac_run_{uuid.uuid4().hex}"
        if not dealt and self.state["buckets"] != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            counts = counts.repartition(self.state["buckets"], "key")
        counts.write.bucketBy(self.state["buckets"], "key").sortBy("key").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return {"name": name, "keys": self._run(name).count()}

    def matches(self, run: dict) -> DataFrame:
        """Keys of a run that it has twice or that a historical run has: merge
        joins of buckets as they lie."""
        found, met = self._run(run["name"]), F.col("times") > 1
        for i, old in enumerate(self.state["runs"]):
            found = found.join(self._run(old["name"]).select("key", F.lit(1).alias(f"old{i}")).hint("merge"), "key", "left")
            met = met | F.col(f"old{i}").isNotNull()
        return found.where(met).select("key")

    def append(self, batch: DataFrame, known: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
        """Add a batch of (doc, print, text) rows, and find which of its windows
        also start elsewhere in it or in what the index holds, and which of those
        held do so now. known: such rows of all batches up to this one. Returns
        (doc, print, at, n) of the repeated windows."""
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            rows = self._write(fingerprints(batch, window, gram), "rows")
            fresh = self.spark.read.schema(RUN).parquet(rows)
            run = self._new_run(fresh.groupBy("key").agg(F.count("*").alias("times")))
            since = made()
            keys = materialize(self.matches(run), "keys")
            self.state["rows"].append(rows)
            self.state["runs"].append(run)
            held = self.spark.read.schema(RUN).parquet(*self.state["rows"])
            found = self._write(repeated_windows(known, held.join(keys, "key", "left_semi"), window), "repeats")
            forget(self.spark, since, made())
            self.state["repeats"].append(found)
            self._compact()
        finally:
            self.spark.conf.set(ORDERED, before)
        self._commit()
        return self.spark.read.schema(REPEATS).parquet(found)

    def _compact(self) -> None:
        """While the last run but one is less than `tier` times the last, merge
        the two; so runs are few and each key is rewritten few times."""
        runs = self.state["runs"]
        while len(runs) > 1 and runs[-2]["keys"] < self.tier * max(runs[-1]["keys"], 1):
            a, b = runs[-2:]
            more = self._run(b["name"]).withColumnRenamed("times", "more").hint("merge")
            both = self._run(a["name"]).join(more, "key", "full").select("key", (F.coalesce("times", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("times"))
            runs[-2:] = [self._new_run(both, dealt=True)]
            for old in (a, b):
                self.spark.sql(f"DROP TABLE {old['name']}")
                remove(self.spark, f"{self.folder}/{old['name']}")

    def repeats(self) -> DataFrame:
        """(doc, print, at, n) of all repeated windows found so far."""
        if not self.state["repeats"]:
            return self.spark.createDataFrame([], REPEATS)
        return self.spark.read.schema(REPEATS).parquet(*self.state["repeats"])


def windows(docs: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, hash, need, doc, print, at) of each window of the asked rows
    (key, n, doc, print, at, need)."""
    per = asked.groupBy("doc", "print").agg(F.collect_list(F.struct("key", "at", "n", "need")).alias("asked"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = np.frombuffer(b.column(2)[i].as_buffer(), np.uint8)
                starts, ends, _ = hs.words(data, np.array([0, len(data)]))
                a = b.column(3)[i].values
                at, n = (np.asarray(a.field(k)).astype(np.int64) for k in (1, 2))
                own = np.repeat(np.arange(len(n)), n)
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[own]
                h = Stretches(hs.word_hashes(data, starts, ends))(start, start + window)
                of = pa.array(own)
                yield pa.RecordBatch.from_arrays([a.field(0).take(of), pa.array(h.view(np.int64)), a.field(3).take(of), pa.repeat(b.column(0)[i], len(start)), pa.repeat(b.column(1)[i], len(start)), pa.array(start.astype(np.int32))], ["key", "hash", "need", "doc", "print", "at"])

    return docs.join(per, ["doc", "print"]).select("doc", "print", F.col("text").cast("binary"), "asked").mapInArrow(rows, "key long, hash long, need boolean, doc long, print long, at int")


def repeated_windows(docs: DataFrame, rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, print, at, n): starts of windows that also start elsewhere, of
    fingerprint rows whose keys are matched."""
    rows = materialize(rows, "repeated")
    groups = materialize(rows.groupBy("key", "stretch", "n").agg(F.count("*").alias("times"), F.min(F.struct("doc", "print", "at")).alias("one")), "groups")
    whole = rows.join(groups.where("times > 1").select("key", "stretch", "n"), ["key", "stretch", "n"], "left_semi").select("doc", "print", "at", "n")
    several = groups.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    asked = groups.join(several, "key", "left_semi").select("key", "n", "one.*", (F.col("times") == 1).alias("need"))
    found = materialize(windows(docs, asked, window), "windows")
    twice = materialize(found.groupBy("key", "hash").agg(F.count("*").alias("times"), F.max("need").alias("any")).where("times > 1 and any").select("key", "hash"), "twice")
    single = found.where("need").join(twice, ["key", "hash"], "left_semi").select("doc", "print", "at", F.lit(1).alias("n"))
    return whole.union(single)


def spans(repeats: DataFrame) -> DataFrame:
    """(doc, print, spans): one set of spans, which serves all equal rows."""
    return repeats.groupBy("doc", "print").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def removed(docs: DataFrame, repeats: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and the kept words as text."""
    joined = docs.join(spans(repeats), ["doc", "print"], "left").select(F.when(F.col("doc") != -(2**62), F.col("doc")).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, sha, texts = [], [], [], []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                words = text.as_py().split()
                total.append(len(words))
                if spans.is_valid:
                    at, n = (np.asarray(spans.values.field(k)).astype(np.int64) for k in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + window - 1, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(texts, pa.string())] * with_text], names)

    return joined.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def deduplicated(docs: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Index docs batch by batch, then drop repeated windows' words."""
    rows = keyed(docs)
    index = FingerprintIndex(docs.sparkSession)
    batch = F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(batches))
    for b in range(batches):
        index.append(rows.where(batch == b), rows.where(batch <= b), window, gram)
    return removed(rows, index.repeats(), window, with_text)


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))
