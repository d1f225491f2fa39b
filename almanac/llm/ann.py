"""Approximate nearest neighbours on balanced posting lists.

Centroids are fitted by spherical k-means on a bounded sample, one for each
`list_rows` vectors up to `most_lists`; centroids of too large clusters are
split, so lists stay balanced. Every vector goes to its nearest list; boundary
vectors also go to further ones, where the distance is within `boundary` of
the nearest and the new centroid is not nearer to one chosen already than to
the vector (up to `replicas`). A query searches the centroids by best-first
search on an in-memory neighbour graph and takes all lists whose distance is
within a ratio of the nearest one's. The ratio is fitted on the sample, so that
`recall` of its nearest neighbours lie in the lists taken.

Lists and the queries that meet in them are dealt in blocks of bounded size. A
query travels once for each group of `GROUP` lists, with the numbers of those
that it takes there, and in batches of bounded bytes, so that neither a worker nor
the shuffle holds a vector for each list. The two nearest lists come first, and what they give is the score that anything
in further lists has to reach. Scores are exact cosines in double precision. Equal vectors are one class with
its k + 1 smallest ids, and equal queries are searched once, so copies cost
neither a hot list nor repeated work. Broadcast are centroids and their graph,
`most_lists` rows.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most take no part, and rows with null
id neither; ties go to smaller ids; repeated rows (id and vector) are one;
fewer candidates than k give fewer rows; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.session import materialize, read

#: Lists whose queries travel together, and the bytes of vectors in one batch of them.
GROUP, SENT = 32, 4 << 20


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ c.T, 0))


@dataclass
class Lists:
    """Centroids, their neighbour graph, and how lists are taken."""

    centroids: np.ndarray
    graph: np.ndarray
    boundary: float
    replicas: int
    ratio: float

    def assigned(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each vector (unit length)."""
        out = []
        for at in range(0, len(x), 2048):
            d = distances(x[at : at + 2048], self.centroids)
            near = np.argsort(d, axis=1, kind="stable")[:, : 4 * self.replicas]
            for row, order in zip(d, near, strict=True):
                chosen = [int(order[0])]
                for c in order[1:]:
                    if len(chosen) == self.replicas or row[c] > (1 + self.boundary) * row[chosen[0]] + 1e-12:
                        break
                    if (distances(self.centroids[c : c + 1], self.centroids[chosen]) > row[c]).all():
                        chosen.append(int(c))
                out.append(chosen)
        return out

    def taken(self, q: np.ndarray, beam: int = 32) -> list[int]:
        """Lists for one query, nearest first: best-first on the graph while the next node is
        within the ratio, or among the `beam` nearest so far."""
        entry = range(0, len(self.centroids), max(1, len(self.centroids) // 8))
        seen = set(entry)
        d0 = distances(q[None], self.centroids[list(entry)])[0]
        todo = [(float(d), c) for d, c in zip(d0, entry, strict=True)]
        heapq.heapify(todo)
        best: list[float] = []  # negated, the beam nearest
        found: list[tuple[float, int]] = []
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) == beam and d > -best[0] and d > self.ratio * found_min:
                break
            found.append((d, c))
            found_min = min(d, found_min) if len(found) > 1 else d
            heapq.heappush(best, -d)
            if len(best) > beam:
                heapq.heappop(best)
            fresh = [int(n) for n in self.graph[c] if n not in seen]
            if fresh:
                seen.update(fresh)
                for n, dn in zip(fresh, distances(q[None], self.centroids[fresh])[0].tolist(), strict=True):
                    heapq.heappush(todo, (dn, n))
        least = min(d for d, _ in found)
        return [c for d, c in sorted(found) if d <= self.ratio * least + 1e-9]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, 1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        sums[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        c = unit(sums + 1e-12)
    return c


def fit(sample: np.ndarray, lists: int, replicas: int, boundary: float, k: int, recall: float, neighbours: int = 24) -> Lists:
    """Lists of a sample of distinct vectors."""
    x = unit(sample)
    c = kmeans(x, lists)
    for _ in range(4):  # split what holds over twice its share
        own = np.argmax(x @ c.T, 1)
        n = np.bincount(own, minlength=len(c))
        large = np.flatnonzero(n > max(2 * len(x) / len(c), 8))
        if not len(large):
            break
        halves = [kmeans(x[own == g], 2, 4) for g in large]
        c = np.concatenate([np.delete(c, large, 0), *halves])
    d = distances(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(neighbours, len(c) - 1)]
    far = np.random.default_rng(11).integers(0, len(c), (len(c), 4))  # some long edges keep the graph connected
    index = Lists(c, np.concatenate([near, far], 1), boundary, replicas, 1.0)
    asked = np.random.default_rng(5).choice(len(x), min(512, len(x)), replace=False)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    true = np.argsort(-s, axis=1, kind="stable")[:, : min(k, max(len(x) - 1, 0))]
    dq = distances(x[asked], c)
    owned = index.assigned(x[np.unique(true)]) if true.size else []
    of = dict(zip(np.unique(true).tolist(), owned, strict=True))
    ratios = [dq[i, of[t]].min() / max(dq[i].min(), 1e-9) for i, row in enumerate(true.tolist()) for t in row]
    index.ratio = float(max(1.0, np.quantile(ratios, recall))) if ratios else 2.0
    return index


def posted(index: Lists, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, list, cls, v) of vectors (cls, v), for each list that holds one."""
    for b in batches:
        lists = index.assigned(unit(matrix(b.column(1)))) if b.num_rows else []
        own = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, lists))), pa.int64())
        flat = np.asarray([c for x in lists for c in x], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(flat // GROUP), pa.array(flat), b.column(0).take(own), b.column(1).take(own)], ["grp", "list", "cls", "v"])


def asked_of(index: Lists, batches: Iterator[pa.RecordBatch], most: int = SENT) -> Iterator[pa.RecordBatch]:
    """(grp, cls, v, lists, first) of queries (cls, v): the lists that each takes
    in each group, its two nearest apart; a batch has vectors of about `most`
    bytes, or one query's."""

    def batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        grp, lists, first, at = zip(*rows, strict=True) if rows else ((),) * 4
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), b.column(0).take(own), b.column(1).take(own), pa.array(lists, pa.list_(pa.int32())), pa.array(first, pa.bool_())], ["grp", "cls", "v", "lists", "first"])

    for b in batches:
        rows: list[tuple] = []
        x = unit(matrix(b.column(1))) if b.num_rows else []
        for i, q in enumerate(x):
            by: dict[tuple[bool, int], list[int]] = {}
            for place, c in enumerate(index.taken(q)):
                by.setdefault((place < 2, c // GROUP), []).append(c)
            if rows and (len(rows) + len(by)) * 8 * len(q) > most:
                yield batch(b, rows)
                rows = []
            rows += [(g, lists, first, i) for (first, g), lists in by.items()]
        yield batch(b, rows)


def valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, asked: Column, k: int = 5, list_rows: int = 256, most_lists: int = 4096, most_sample: int = 20_000, replicas: int = 4, boundary: float = 0.15, recall: float = 0.97, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for
    which `asked` holds, among all others."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v"))).distinct()
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == usual["size"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    classes = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "v", "ids"), "classes")
    total = classes.count()
    share = min(1.0, 0.95 * most_sample / total)
    sample = np.asarray([r["v"] for r in classes.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("v").orderBy("v").limit(most_sample).collect()], float)
    index = fit(sample, int(min(most_lists, max(1, total // list_rows), len(sample))), replicas, boundary, k, recall)
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    postings = classes.select("cls", "v").mapInArrow(lambda batches: posted(sent.value, batches), "grp int, list int, cls long, v array<double>")
    who = materialize(rows.where(asked).select(F.col("vec_id").alias("query_id"), "v").join(classes.select("v", "cls"), "v").select("query_id", "cls"), "asked")
    distinct_queries = classes.join(who.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    wanted = materialize(distinct_queries.repartition("cls").mapInArrow(lambda batches: asked_of(sent.value, batches), "grp int, cls long, v array<double>, lists array<int>, first boolean"), "taken")
    postings = materialize(postings, "postings")

    def met(turned: DataFrame) -> DataFrame:
        """(query, cls, score): for each list and query the k + 1 best that
        reach the query's least score, dealt in blocks of bounded size."""
        sizes = postings.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("chunks")).join(turned.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("turns")), "grp")
        left = postings.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("grp", "chunk", "turn", "list", "cls", "v")
        right = turned.join(sizes, "grp").withColumn("turn", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("turns"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("grp", "chunk", "turn", "cls", "v", "lists", "least")
        keys = ["grp", "chunk", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, "query long, cls long, score double")

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        if len(a) and len(b):
            a = a.sort_values(["list", "cls"])
            every, cls, of = np.stack(a["v"].to_numpy()), a["cls"].to_numpy(), a["list"].to_numpy()
            norms = np.sqrt((every * every).sum(1))
            asks, query, least = np.stack(b["v"].to_numpy()), b["cls"].to_numpy(), b["least"].to_numpy()
            owner = np.repeat(np.arange(len(b)), b["lists"].map(len).to_numpy())
            wants = np.concatenate(b["lists"].to_list())
            for c in np.unique(of):
                low, high = np.searchsorted(of, [c, c + 1])
                x, nx, most = every[low:high], norms[low:high], min(k + 1, high - low)
                mine = owner[wants == c]
                for at in range(0, len(mine), 512):
                    part = mine[at : at + 512]
                    q = asks[part]
                    s = (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * nx)
                    top = np.argsort(-s, axis=1, kind="stable")[:, :most]
                    best = np.take_along_axis(s, top, 1)
                    row, col = np.nonzero(best >= least[part][:, None])
                    out.append(pd.DataFrame({"query": query[part][row], "cls": cls[low + top[row, col]], "score": best[row, col]}))
        return pd.concat(out)

    # the nearest lists give each query a score that the others have to reach
    first = materialize(met(wanted.where("first").select("grp", "cls", "v", "lists", F.lit(-2.0).alias("least"))), "first")
    reach = first.groupBy("query", "cls").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("r") == k + 1)
    reach = reach.select(F.col("query").alias("cls"), (F.col("score") - 1e-12).alias("least"))
    others = wanted.where(~F.col("first")).join(reach, "cls", "left").select("grp", "cls", "v", "lists", F.coalesce("least", F.lit(-2.0)).alias("least"))
    near = first.union(met(others)).groupBy("query", "cls").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    near = near.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).drop("r")
    each = near.join(classes.select("cls", "ids"), "cls").select(F.col("query").alias("cls"), "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    found = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    # each query leaves itself out
    hit = who.join(found, "cls").select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return hit.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
