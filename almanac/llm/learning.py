"""Small learners for bounded samples of labelled rows: boosted trees on binned
features, a decision tree as their special case, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for the rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int) -> DataFrame:
    """(doc_id, text, label, fold 0-9) of about `most` labelled rows at most,
    none held out. Rows are taken by a hash of doc_id; the taken labels, of
    bounded number, are sent to where the documents are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    count = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    taken = known.where(draw < int(1_000_000 * min(1.0, most / max(count, 1))))
    taken = taken.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(10)).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")


@dataclass
class Isotonic:
    """A non-decreasing step function through pooled means, linear between."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    @staticmethod
    def fit(raw: np.ndarray, label: np.ndarray, prior: float = 1.0) -> Isotonic:
        """prior: weight of one pseudo-row of the mean label in each pool."""
        if not len(raw):
            return Isotonic()
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, sum of raw
        for r, v in zip(raw[order].tolist(), label[order].tolist(), strict=True):
            pools.append([v, 1.0, r])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                for i in range(3):
                    pools[-1][i] += a[i]
        mean = float(label.mean())
        p = np.asarray(pools)
        y = np.maximum.accumulate((p[:, 0] + prior * mean) / (p[:, 1] + prior))
        return Isotonic(p[:, 2] / p[:, 1], y)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


@dataclass
class Trees:
    """Trees on binned features; a node is (feature, bin, left, right) with
    feature -1 at a leaf, whose value stands apart."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for nodes, values in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(x) and (inner := nodes[at, 0] >= 0).any():
                n = nodes[at[inner]]
                right = b[inner, n[:, 0]] > n[:, 1]
                at[inner] = np.where(right, n[:, 3], n[:, 2])
            out += values[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss by Newton steps on histograms.
    rounds=1 and rate=1 give a plain decision tree of log odds."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(mean / (1 - mean))), [])
    if len(np.unique(y)) < 2:
        return model
    b, score, width = model.binned(x), np.full(len(y), model.base), bins + 1
    flat = b + np.arange(b.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        nodes, values, todo = [[-1, 0, 0, 0]], [0.0], [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            values[at] = rate * gs / (hs + ridge)
            score_here = gs * gs / (hs + ridge)
            best = None
            if level < depth and len(rows) >= 2 * least:
                f = flat[rows].ravel()
                n = width * b.shape[1]
                gh, hh, ch = (np.bincount(f, np.repeat(v, b.shape[1]), n).reshape(-1, width).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows))))
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - score_here
                gain[(ch < least) | (len(rows) - ch < least)] = -1
                j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                best = (int(j), int(k)) if gain[j, k] > 1e-6 else None
            if best is None:
                score[rows] += values[at]
                continue
            j, k = best
            right = b[rows, j] > k
            nodes[at] = [j, k, len(nodes), len(nodes) + 1]
            todo += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            values += [0.0, 0.0]
        inner = np.asarray(nodes)
        model.trees.append((inner, np.where(inner[:, 0] >= 0, 0.0, np.asarray(values))))
    return model
