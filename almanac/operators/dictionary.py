"""Which names of a dictionary a text holds, as whole words.

A dictionary is a table (rango, nombre). One of a checked size becomes an
automaton, built once in each Python worker, that reads a text once however many
names there are; a larger one is joined to the texts' runs of words, of the
lengths that names have. Both give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.text import words_and_digits
from almanac.session import ship

HIT = "rango int, nombre string, desde int"
_BUILT: dict[str, object] = {}


def of(spark: SparkSession, names: list[str]) -> DataFrame:
    """A list of names, in order, as a dictionary."""
    return spark.createDataFrame(list(enumerate(names)), "rango int, nombre string")


def normalized(names: DataFrame) -> DataFrame:
    """(rango, nombre, _n): names that have words, with these words."""
    return names.select(F.col("rango").cast("int").alias("rango"), "nombre", words_and_digits(F.col("nombre")).alias("_n")).where("_n <> ''")


def hits(texts: DataFrame, key: str, text: Column, names: DataFrame, most: int = 100_000) -> DataFrame:
    """(key, rango, nombre, desde) of each place where a text holds a name;
    desde counts words from 0. At most `most` names are sent to the workers."""
    known = normalized(names)
    if known.limit(most + 1).count() <= most:
        return by_automaton(texts, key, text, known)
    return by_runs(texts, key, text, known)


def automaton(rows: list[tuple[int, str, str]]):
    """Names (rango, nombre, words) as one automaton over " word word "."""
    import ahocorasick

    a = ahocorasick.Automaton()
    same: dict[str, list[tuple[int, str, int]]] = {}
    for rank, name, words in rows:
        same.setdefault(f" {words} ", []).append((rank, name, words.count(" ") + 1))
    for words, found in same.items():
        a.add_word(words, found)
    if same:
        a.make_automaton()
    return a if same else None


def by_automaton(texts: DataFrame, key: str, text: Column, known: DataFrame) -> DataFrame:
    ship(texts.sparkSession)
    rows = [tuple(r) for r in known.select("rango", "nombre", "_n").collect()]
    sent, build = texts.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if build not in _BUILT:
            _BUILT.clear()
            _BUILT[build] = automaton(sent.value)
        a = _BUILT[build]
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1)):
                hay = f" {t.as_py()} "
                starts, seen = 0, 0  # words before the place that was counted last
                for end, found in a.iter(hay) if a else ():
                    starts, seen = starts + hay.count(" ", seen, end), end
                    for rank, name, n in found:
                        at.append(i)
                        out.append((rank, name, starts - n))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["k", "rango", "nombre", "desde"])

    plain = texts.where(text.isNotNull()).select(F.col(key).alias("k"), words_and_digits(text).alias("t"))
    kind = plain.schema["k"].dataType.simpleString()
    return plain.mapInArrow(read, f"k {kind}, {HIT}").withColumnRenamed("k", key)


def by_runs(texts: DataFrame, key: str, text: Column, known: DataFrame) -> DataFrame:
    longest = known.agg(F.max(F.size(F.split("_n", " ")))).first()[0] or 1
    sizes = F.array(*[F.lit(n) for n in range(1, longest + 1)])
    words = texts.where(text.isNotNull()).select(key, F.split(words_and_digits(text), " ").alias("_w"))
    runs = words.select(key, "_w", F.posexplode("_w").alias("desde", "_")).select(key, "desde", "_w", F.explode(sizes).alias("_k")).where("desde + _k <= size(_w)")
    return runs.select(key, "desde", F.array_join(F.slice("_w", F.col("desde") + 1, F.col("_k")), " ").alias("_n")).join(known, "_n").select(key, "rango", "nombre", "desde")


def first_hit(texts: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """texts with nombre: the name of least rank that each holds, null without."""
    best = hits(texts.select(key, text.alias("_t")), key, F.col("_t"), names).groupBy(key).agg(F.min(F.struct("rango", "nombre")).alias("_b"))
    return texts.join(best.select(key, F.col("_b.nombre").alias("nombre")), key, "left")


def all_hits(texts: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """texts with nombres: the names that each holds, by rank, once each."""
    found = hits(texts.select(key, text.alias("_t")), key, F.col("_t"), names).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("rango", "nombre"))).alias("_b"))
    none = F.array().cast("array<string>")
    return texts.join(found, key, "left").withColumn("nombres", F.coalesce(F.transform("_b", lambda x: x["nombre"]), none)).drop("_b")


def longest_hits(found: DataFrame, key: str) -> DataFrame:
    """Of hits that begin at one word, the longest name; ties to the least rank."""
    w = Window.partitionBy(key, "desde").orderBy(F.desc(F.size(F.split(words_and_digits(F.col("nombre")), " "))), "rango", "nombre")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
