"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct k-word shingles. Register j of its sketch is
floor(1 - log_b x), cut to 16 bits, of the least x among exponential variates
of rate `RATE`, one for each shingle: the spaced, truncated minima of SetSketch,
so that sketches of parts merge by the larger register. Documents of equal
sets (equal in size and in 128 bits, the sum of two mixes of all hashes) are one
class from the start; a class is numbered when the table of classes is written.

1. Registers are banded (`bands` of `rows`); classes that share a band key are
   candidates. At similarity 0.8 all 40 bands of 5 miss with probability 1e-7.
2. In each bucket every class is paired with the most central one (that which
   meets most others over all its buckets). Pairs that the joint likelihood of
   both sketches puts 7 standard errors under the threshold go; the others are
   verified on full sets. So a group of copies costs a star, not all pairs.
3. Buckets whose other members are still in different components are compared
   in full, in blocks of bounded size, by cluster and by set size (similar
   sets have similar sizes), only between components; each block emits links
   that join something. No link between different sets is lost after banding.
4. Components of the verified links, by alternating stars.

Defined results: null and empty texts, and those without words, have 0
shingles and are linked with nothing, not even each other; a null doc_id is in
no link (its component is null, it is kept); repeated rows share a class and
each get its component; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import hashing as hs
from almanac.llm.graph import components
from almanac.llm.shingles import distinct, shingled
from almanac.session import materialize, read, sized, unused

BASE, RATE, TOP = 1.001, 20.0, 65_535
U64 = hs.U64


# ---------------------------------------------------------------- sketches
@np.errstate(over="ignore", divide="ignore")
def registers(h: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """(documents, m) registers of documents that have shingles."""
    least = np.empty((m, len(offs) - 1), U64)
    for j in range(m):
        least[j] = np.minimum.reduceat(hs.permuted(h, j), offs[:-1])
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2").T.copy()


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """The similarity of largest joint likelihood, by how many registers of
    each pair are larger, smaller and equal, at known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)

    up, down = p((u - v * j) / 1.0), p((v - u * j) / 1.0)
    fit = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def printed() -> Column:
    """A hash of the text, which tells texts of a repeated doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("print")


def prints(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, print, n, hi, lo, registers): a hash of the text, set size, 128
    bits that name the set, sketch (null without shingles)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, offs in shingled(b.column(1), k, 1 << 20):
                h, offs = distinct(h, offs)
                n = np.diff(offs)
                some = np.flatnonzero(n)
                at = np.concatenate([offs[:-1][some], offs[-1:]])
                regs, names = [None] * (hi - lo), np.zeros((2, hi - lo), U64)
                if len(some):
                    for d, r in zip(some.tolist(), registers(h, at, m), strict=True):
                        regs[d] = r.tobytes()
                    for s in (0, 1):
                        names[s, some] = np.add.reduceat(hs.mix(h ^ hs.MULTIPLIER[s]), at[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *map(pa.array, names.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "print", "n", "hi", "lo", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), printed()).mapInArrow(rows, "doc_id long, print long, n long, hi long, lo long, registers binary")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(cls, shingles): the sorted distinct hashes of each (text, cls, hi, lo)
    whose text is of that class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, hi_, lo_ = (b.column(i).to_numpy() for i in (1, 2, 3))
            for first, _last, h, offs in shingled(b.column(0), k, 1 << 20):
                h, offs = distinct(h, offs)
                for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    s = h[x:y]
                    named = [int(hs.mix(s ^ hs.MULTIPLIER[j]).sum(dtype=U64).view(np.int64)) for j in (0, 1)]
                    if y > x and named == [hi_[first + i], lo_[first + i]]:
                        yield pa.RecordBatch.from_arrays([pa.array([cls[first + i]]), pa.array([s.tobytes()], pa.binary())], ["cls", "shingles"])

    return docs.select(F.col("text").cast("string"), "cls", "hi", "lo").mapInArrow(rows, "cls long, shingles binary")


def similar(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


# ------------------------------------------------------------------- stars
def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) that the estimate leaves, without sketches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.stack([np.frombuffer(x, "<u2") for x in batch.column(i).to_pylist()]) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            t = percent / 100
            keep = likelihood(ra, rb, na, nb) >= t - 7 * np.sqrt(t * (1 - t) / ra.shape[1])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(rows, "a long, b long")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose full sets are similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                keep.append(bool(similar(len(np.intersect1d(x, y, True)), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


# ------------------------------------------------------------------ blocks
def block_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the components of a block that join something: rows
    (cls, comp, n, side, shingles). Sides 0 and 1 are compared with each other,
    side 2 with itself."""
    rows = rows.drop_duplicates(["cls", "side"]).sort_values(["n", "cls"], ignore_index=True)
    usual = rows["comp"].mode().iloc[0]
    sizes, comp, cls, side = (rows[c].to_numpy() for c in ("n", "comp", "cls", "side"))
    data = [np.frombuffer(x, U64) for x in rows["shingles"]]
    hashes, owner = np.concatenate(data), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i in np.flatnonzero(comp != usual):
        lo, hi = np.searchsorted(hashes, data[i], "left"), np.searchsorted(hashes, data[i], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        inter = np.bincount(owner[at], minlength=len(rows))
        met = similar(inter, sizes[i], sizes, percent) & (comp != comp[i]) & ((side == 2) | (side != side[i]))
        for j in np.flatnonzero(met):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(cls[i]), int(cls[j])))
    return out


def rest_links(rest: DataFrame, shingles: DataFrame, percent: int, block: int = 400_000) -> DataFrame:
    """All links between different components of a cluster: rest has
    (cluster, cls, comp, n). Blocks of about `block` shingles of one size class
    (sizes within a factor of 100/percent) meet those of the same class and of
    the next one."""
    size = F.floor(F.log("n") / np.log(100 / percent))
    rest = rest.withColumn("size", size)
    counts = rest.groupBy("cluster", "size").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    around = [counts.select("cluster", (F.col("size") - d).alias("size"), F.col("blocks").alias(f"blocks{d + 1}")) for d in (-1, 0, 1)]
    placed = rest
    for near in around:
        placed = placed.join(near, ["cluster", "size"], "left")
    b = F.pmod(F.xxhash64("cls"), F.col("blocks1"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks1") - 1), lambda x: F.struct(F.col("size").alias("s"), F.lit(0).alias("up"), F.least(b, x).alias("x"), F.greatest(b, x).alias("y"), F.when(x == b, 2).when(b < x, 0).otherwise(1).alias("side")))
    none = F.array().cast("array<struct<s:bigint,up:int,x:bigint,y:bigint,side:int>>")
    up = F.when(F.col("blocks2").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks2") - 1), lambda x: F.struct(F.col("size").alias("s"), F.lit(1).alias("up"), b.alias("x"), x.alias("y"), F.lit(0).alias("side"))))
    down = F.when(F.col("blocks0").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks0") - 1), lambda x: F.struct((F.col("size") - 1).alias("s"), F.lit(1).alias("up"), x.alias("x"), b.alias("y"), F.lit(1).alias("side"))))
    dealt = placed.withColumn("to", F.explode(F.concat(own, up, down))).select("cluster", "cls", "comp", "n", "to.*")
    # a block without two components or two sides has nothing to compare
    key = ["cluster", "s", "up", "x", "y"]
    useful = dealt.groupBy(*key).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("side").alias("s0"), F.max("side").alias("s1")).where((F.col("c0") != F.col("c1")) & ((F.col("s0") != F.col("s1")) | (F.col("s0") == 2))).select(*key)
    dealt = dealt.join(useful, key).join(shingles.select("cls", "shingles"), "cls")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(pdf, percent), columns=["a", "b"]).astype("int64")

    return dealt.groupBy(*key).applyInPandas(group, "a long, b long")


# -------------------------------------------------------------------- whole
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    return resolved(docs, k, percent, bands, rows).drop("print")


def resolved(docs: DataFrame, k: int, percent: int, bands: int = 40, rows: int = 5) -> DataFrame:
    """The same with the print of each row's text."""
    name = ["n", "hi", "lo"]
    found = materialize(prints(docs, k, bands * rows), "prints")
    classes = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*name).agg(F.min("doc_id").alias("least"), F.first("registers").alias("registers"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbered for good once written
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * rows * i + 1, 2 * rows)) for i in range(bands)])
    band = classes.select("cls", F.explode(keys).alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(band.join(shared, "key").join(classes.select("cls", "n"), "cls"), "members")

    # central: meets most others, then least class
    central = members.groupBy("cls").agg(F.sum("members").alias("met"))
    ranked = members.join(central, "cls")
    first = ranked.groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("cls")).alias("minus"))).alias("top"), F.first("members").alias("size")).select("key", (-F.col("top.minus")).alias("pivot"), "size")
    star = members.join(first, "key").where(F.col("cls") != F.col("pivot")).select(F.col("cls").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na")).distinct()
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    left = classes.select(F.col("cls").alias("a"), F.col("registers").alias("ra"))
    sized = star.join(right, "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))).join(left, "a")
    pairs = materialize(likely(sized, percent), "pairs")

    wanted = members.select("cls").distinct().join(classes, "cls").select(F.col("least").alias("doc_id"), "cls", "hi", "lo")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    shingles = materialize(sets(texts, k).dropDuplicates(["cls"]), "sets")

    sa, sb = (shingles.select(F.col("cls").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    links = materialize(verified(pairs.join(sa, "a").join(sb, "b"), percent), "near")
    roots = components(links)

    # buckets whose members besides the pivot are in different components
    state = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).join(first.select("key", "pivot"), "key").where(F.col("cls") != F.col("pivot"))
    open_ = state.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("cls").alias("lead")).where("c0 != c1").select("key", "lead")
    rest = materialize(state.join(open_, "key").select("lead", "cls", "comp", "n").distinct(), "rest")
    if not rest.isEmpty():
        cluster = components(rest, "cls", "lead").withColumnRenamed("node", "cls").withColumnRenamed("root", "cluster")
        more = rest_links(rest.select("cls", "comp", "n").distinct().join(cluster, "cls"), shingles, percent)
        more = materialize(more, "more")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    owner = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    least = owner.groupBy("root").agg(F.min("least").alias("component"))
    named = owner.join(least, "root").join(classes.select("cls", *name), "cls").select(*name, "component")
    component = F.when(F.col("component").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "print", *name).join(named, name, "left").select("doc_id", "print", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs less the rows that are not kept, all columns kept. A row goes by its
    doc_id and text: of a repeated doc_id only the texts that are copies go;
    equal rows and rows without an id stay."""
    doc, print_ = unused(docs, "gone_doc", "gone_print")
    gone = resolved(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("print").alias(print_)).distinct()
    here = (F.col("doc_id").cast("long") == F.col(doc)) & (printed() == F.col(print_))
    return docs.join(sized(materialize(gone, "gone")), here, "left_anti")


def op7_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)
