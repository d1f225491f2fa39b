"""The stored table: upsert, purge, mirror and novelty, as whole-table plans.

A plan never writes what it reads: replace() writes beside and swaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators.resolve import key as canonical_key


def upsert(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of either, with the columns of both; where both have the key, the
    batch's values that are not null win, in the columns that it has. Repeating a
    batch changes nothing."""
    b = batch.select(*[F.col(c).alias(f"_{c}") for c in batch.columns])
    joined = stored.join(b, F.col(key) == F.col(f"_{key}"), "full_outer")
    both = [(F.coalesce(f"_{c}", c) if c in batch.columns else F.col(c)).alias(c) for c in stored.columns]
    return joined.select(*both, *[F.col(f"_{c}").alias(c) for c in batch.columns if c not in stored.columns])


def purge(stored: DataFrame, date: str, day: str) -> DataFrame:
    """Rows on or after day, and those without a date."""
    return stored.where(F.coalesce(F.col(date) >= F.lit(day).cast("date"), F.lit(True)))


def gone(previous: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Keys to delete from a mirror."""
    return previous.select(key).join(current.select(key), key, "left_anti")


def novel(batch: DataFrame, shown: DataFrame, key: str = "id") -> DataFrame:
    return batch.join(shown.select(key), key, "left_anti")


def deduplicated(stored: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group (id, grupo) of stored rows: the one with an hour,
    the larger line-up, the longer title and the smaller id stays, with the
    longest title, united line-ups and sources and the largest score. In every
    other column it keeps its value, or where it has none the next row's that has
    one. What has no clave, fuentes or estado gets them. A row without a group
    stays alone."""
    rows = stored.join(groups, "id", "left").withColumn("grupo", F.coalesce("grupo", "id"))
    for name, kind in (("clave", "string"), ("estado", "string"), ("fuentes", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    first = F.struct(F.col("hora") == "", -F.size("orquestas"), -F.char_length("titulo"), "id")
    told = F.filter(F.array_distinct(F.concat(F.coalesce("fuentes", F.array().cast("array<string>")), F.array("fuente"))), lambda x: x.isNotNull())
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = {
        "titulo": F.min_by("titulo", F.struct(-F.char_length("titulo"), "id")), "orquestas": union("orquestas"), "fuentes": union("fuentes"), "score": F.max("score"),
        "estado": F.coalesce(F.min_by("estado", first), F.lit("activo")), "hora": F.min_by("hora", first), "id": F.min_by("id", first),
    }
    kept = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), first))
    names = [c for c in rows.columns if c != "grupo"]
    out = rows.withColumn("fuentes", told).groupBy("grupo").agg(*[merged.get(c, kept(c)).alias(c) for c in names])
    own = canonical_key(F.col("municipio"), F.col("day"), F.try_element_at("orquestas", F.lit(1)), F.col("titulo"))
    return out.withColumn("clave", F.coalesce("clave", own)).select(*names)


def with_states(stored: DataFrame, signals: DataFrame) -> DataFrame:
    """Stored rows with estado and posibleCancelacion after the newest signal of
    each (id, at, cancela, retoma): resuming makes active, cancelling marks."""
    last = signals.groupBy("id").agg(F.max_by(F.struct("cancela", "retoma"), F.struct("at", "retoma")).alias("_s"))
    joined = stored.join(last, "id", "left")
    new = {"estado": F.when(F.col("_s.retoma"), "activo").otherwise(F.col("estado")), "posibleCancelacion": F.when(F.col("_s.retoma"), False).when(F.col("_s.cancela"), True).otherwise(F.col("posibleCancelacion"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in stored.columns])


def cached(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """(clave, url, at, texto): the newest text of each address, by its hash."""
    both = cache.select("url", "at", "texto").union(fresh.select("url", "at", "texto"))
    newest = both.groupBy("url").agg(F.max(F.struct("at", "texto")).alias("_n"))
    return newest.select(F.sha1("url").alias("clave"), "url", "_n.at", "_n.texto")


def conflicts(accounts: DataFrame) -> DataFrame:
    """Accounts whose handle an account of smaller id has already."""
    owner = accounts.where(F.col("handle") != "").groupBy("handle").agg(F.min("id").alias("_owner"))
    return accounts.join(owner, "handle").where(F.col("id") != F.col("_owner")).select(*accounts.columns)


def alerts(stored: DataFrame, fresh: DataFrame, most: int = 300) -> DataFrame:
    """(municipio, tipo, url, at, detalle, primero): the newest alert of each
    (municipio, tipo, url), with the time since which it is held. A repeated one
    keeps its place; of more than most, a ring, those held longest go."""
    told = fresh.select("municipio", "tipo", "url", "at", "detalle", F.col("at").alias("primero"))
    newest = F.max(F.struct("at", "detalle")).alias("_n")
    held = stored.unionByName(told).groupBy("municipio", "tipo", "url").agg(newest, F.min("primero").alias("primero"))
    kept = held.orderBy(F.desc("primero"), "municipio", "tipo", "url").limit(most)
    return kept.select("municipio", "tipo", "url", "_n.at", "_n.detalle", "primero")


def imported(accounts: DataFrame, followed: DataFrame, own: str, at: int) -> DataFrame:
    """accounts and the new ones of followed (nombre, url, tipo, municipio), by
    nombre: navigation, the own profile, addresses without a handle and handles
    that an account has are left out; the first of a handle, by url, counts."""
    named, url = F.trim("nombre"), F.trim("url")
    rows = followed.select(named.alias("nombre"), url.alias("url"), "tipo", "municipio", T.handle(url).alias("handle"))
    inner = F.col("nombre").rlike("(?i)editar perfil|solicitudes de amistad") | F.contains("url", F.lit(own)) | F.col("url").rlike(r"/friends/?([?#]|$)")
    new = rows.where(~inner & (F.col("handle") != "")).join(accounts.select("handle"), "handle", "left_anti")
    fields = ("nombre", "url", "tipo", "municipio")
    first = new.groupBy("handle").agg(F.min_by(F.struct(*fields), F.struct("url", "nombre")).alias("_f"))
    made = first.select(T.slug(F.col("_f.nombre")).alias("id"), "handle", *[f"_f.{f}" for f in fields], F.lit(True).alias("activa"), F.lit(at).cast("long").alias("createdAt"), F.lit(at).cast("long").alias("updatedAt"))
    return accounts.unionByName(made).orderBy("nombre", "handle")


def with_media(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Adds imagen to posts: the address of their featured medium, null without."""
    m = media.select(F.col("id").alias("_m"), F.col("source_url").alias("imagen"))
    return posts.join(m, F.col("featured_media") == F.col("_m"), "left").drop("_m")


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def replace(df: DataFrame, path: str) -> None:
    """Write df in place of the table at path, which df may have read. Whoever
    opens the table after a job that was cut off calls recover first."""
    fs, at = _files(df.sparkSession, path)
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)


def back_up(spark: SparkSession, path: str, day: str) -> str:
    """Copy the table at path beside it, as the day's next copy; earlier ones
    stay. The copy's path."""
    fs, at = _files(spark, path)
    numbers = [int(f.getPath().getName().rpartition("-")[2]) for f in (fs.globStatus(at(f"{path}.backup-{day}-*")) or [])]
    copy = f"{path}.backup-{day}-{max(numbers, default=0) + 1:04d}"
    spark.read.parquet(path).write.parquet(copy)
    return copy


def apply_dedup(spark: SparkSession, path: str, groups: DataFrame, day: str, dry: bool = True) -> DataFrame:
    """Back the table at path up and merge the groups (id, grupo) of its rows,
    as they are now. Unless dry, the result takes the table's place, with all of
    its columns. Returns (grupo, ids, n) of the groups that merge: the report."""
    copy = spark.read.parquet(back_up(spark, path, day))
    if not dry:
        replace(deduplicated(spark.read.parquet(path), groups), path)
    merging = copy.select("id").join(groups, "id").groupBy("grupo").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return merging.where("n > 1")


def recover(spark: SparkSession, path: str) -> None:
    """End a swap that was cut off: where the table is missing, the newest whole
    one beside it, new before old, takes its place."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        return
    for kind in ("new", "old"):
        whole = [f for f in (fs.globStatus(at(f"{path}.{kind}-*")) or []) if fs.exists(at(f"{f.getPath()}/_SUCCESS"))]
        if whole:
            fs.rename(max(whole, key=lambda f: f.getModificationTime()).getPath(), at(path))
            return
