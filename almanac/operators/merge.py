"""The store's write path: a batch of events merged into stored ones by two keys.

A row belongs to the stored row of its id; without one, to a row of its canonical
key (clave) and hour, else to the first row of its clave if their hours do not
speak against each other; else it is a new one. Later rows of a batch see
earlier ones. Rows are not read one by one for that: of each (clave, hour) only the
first row of a batch can decide anything, so that a clave's decisions are a fold
over a handful of hours, and everything else is joins and partial aggregates.

The stored table is versioned, and a version's log tells the last number of each
stream that it holds: a batch that comes again changes nothing.

Stored rows have id, clave, fuente, fuentes, estado, actualizadoAt, dayNum and the
columns of EVENT; a batch has EVENT, clave and n, its order. Other columns of either
are kept: the first value that is not null, the stored row's before the batch's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import versions as V

EVENT = "id string, titulo string, day string, hora string, municipio string, lugar string, orquestas array<string>, tipo string, url string, score int, motivos array<string>"
STORED = f"{EVENT}, clave string, fuente string, fuentes array<string>, estado string, actualizadoAt long, dayNum int"
BATCH = f"{EVENT}, clave string, n long"
_KEPT = "array<struct<id:string,hora:string>>"
_OUT = "array<struct<hora:string,id:string>>"


def decided(held: Column, rows: Column) -> Column:
    """(hora, id): to which row the rows (n, id, hora) of one clave belong, in
    order; held: stored rows (id, hora) of it, the first in order of id first."""

    def step(state: Column, r: Column) -> Column:
        kept, out = state["kept"], state["out"]
        twin = F.try_element_at(F.filter(kept, lambda e: (e["hora"] == r["hora"]) & (r["hora"] != "")), F.lit(1))
        base = F.try_element_at(kept, F.lit(1))
        fits = base.isNotNull() & F.coalesce((r["hora"] == "") | (base["hora"] == "") | (base["hora"] == r["hora"]), F.lit(False))
        takes = twin.isNull() & fits
        hour = F.when(base["hora"] == "", r["hora"]).otherwise(base["hora"])
        new = F.when(twin.isNotNull(), kept).when(fits, F.concat(F.array(F.struct(base["id"].alias("id"), hour.alias("hora"))), F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1)))))
        grown = F.concat(kept, F.array(F.struct(r["id"].alias("id"), r["hora"].alias("hora"))))
        to = F.coalesce(twin["id"], F.when(takes, base["id"]), r["id"])
        return F.struct(F.coalesce(new, grown).cast(_KEPT).alias("kept"), F.concat(out, F.array(F.struct(r["hora"].alias("hora"), to.alias("id")))).cast(_OUT).alias("out"))

    start = F.struct(F.coalesce(held, F.array()).cast(_KEPT).alias("kept"), F.array().cast(_OUT).alias("out"))
    return F.aggregate(rows, start, step, lambda s: s["out"])


def targets(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, destino, como) of each id of a batch: the id of the row that its rows
    belong to, and how: "id", "clave" or "nuevo". Rows of one id go together, by
    the first of them."""
    hour = F.coalesce("hora", F.lit(""))
    first = batch.groupBy("id").agg(F.min(F.struct("n", "clave", hour.alias("hora"))).alias("_f")).select("id", "_f.*")
    known = stored.select("id", F.lit(True).alias("_known"))
    met = first.join(known, "id", "left")
    new = met.where("_known IS NULL")
    hours = new.groupBy("clave", "hora").agg(F.min(F.struct("n", "id")).alias("_f"))
    rows = hours.groupBy("clave").agg(F.array_sort(F.collect_list(F.struct("_f.n", "_f.id", "hora"))).alias("rows"))
    held = stored.where("clave IS NOT NULL").select("clave", F.struct("id", hour.alias("hora")).alias("_h")).join(rows.select("clave"), "clave", "left_semi").groupBy("clave").agg(F.array_sort(F.collect_list("_h")).alias("held"))
    told = rows.join(held, "clave", "left").select("clave", F.explode(decided(F.col("held"), F.col("rows"))).alias("_d")).select("clave", "_d.hora", F.col("_d.id").alias("destino"))
    by_clave = new.join(told, ["clave", "hora"], "left").select("id", F.coalesce("destino", "id").alias("destino"))
    how = F.when(F.col("id") == F.col("destino"), "nuevo").otherwise("clave")
    return met.where("_known").select("id", F.col("id").alias("destino"), F.lit("id").alias("como")).unionByName(by_clave.select("id", "destino", how.alias("como")))


def united(rows: DataFrame, column: str, order: str, same: Callable[[Column], Column]) -> DataFrame:
    """(destino, column): the values of an array column, each once (by `same`),
    in the order of rows; summed up before they are shuffled."""
    each = rows.select("destino", order, F.posexplode(column).alias("_i", "_v")).where("_v IS NOT NULL")
    once = each.groupBy("destino", same(F.col("_v")).alias("_s")).agg(F.min(F.struct(order, "_i", "_v")).alias("_x"))
    return once.groupBy("destino").agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_v"]).alias(column))


def merged(stored: DataFrame, batch: DataFrame, source: str, at: int) -> DataFrame:
    """The stored table with a batch merged, and _como, what became of each row:
    null where the batch says nothing about it, "igual" where nothing new. Of the
    rows that belong together the first with an hour leads: it gives what is told
    only once and wins ties; titles are the longest, lists united, scores the largest."""
    to = targets(stored, batch)
    told = F.coalesce("fuentes", F.array("fuente"))
    old = stored.join(to.select("destino").distinct(), F.col("id") == F.col("destino"), "left_semi").select("*", F.col("id").alias("destino"), F.lit(-1).cast("long").alias("n")).withColumn("fuentes", told)
    fresh = batch.join(to.select("id", "destino"), "id").withColumns({"fuente": F.lit(source), "fuentes": F.array(F.lit(source))})
    rows = old.unionByName(fresh, allowMissingColumns=True)
    leads = rows.groupBy("destino").agg(F.min(F.when(F.coalesce("hora", F.lit("")) != "", F.col("n"))).alias("_lead"))
    rows = rows.join(leads, "destino").withColumn("_rank", F.when(F.col("n") == F.col("_lead"), F.lit(-2).cast("long")).otherwise(F.col("n")))

    filled = lambda c, order: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))
    held = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    lead = lambda c: F.min_by(c, "_rank")
    rules = {
        "titulo": F.max_by("titulo", F.struct(F.char_length(F.coalesce("titulo", F.lit(""))), -F.col("_rank"))), "hora": F.coalesce(filled("hora", "n"), F.lit("")), "lugar": F.coalesce(filled("lugar", "_rank"), F.lit("")),
        "url": F.coalesce(filled("url", "_rank"), F.lit("")), "score": F.max("score"), "day": lead("day"), "municipio": lead("municipio"), "tipo": lead("tipo"),
        "clave": F.max_by("clave", F.when(F.col("id") == F.col("destino"), F.col("n")).otherwise(-2)), "estado": F.coalesce(held("estado"), F.lit("activo")),
    }
    arrays = {"orquestas": ("_rank", T.fold), "fuentes": ("_rank", lambda v: v), "motivos": ("n", lambda v: v)}
    names = [c for c in dict.fromkeys([*stored.columns, *batch.columns]) if c not in ("n", "id")]
    one = rows.groupBy("destino").agg(*[rules.get(c, held(c)).alias(c) for c in names if c not in arrays])
    none = F.array().cast("array<string>")
    for c, (order, same) in arrays.items():
        one = one.join(united(rows, c, order, same), "destino", "left").withColumn(c, F.coalesce(c, none))
    how = to.groupBy("destino").agg(F.max(F.when(F.col("como") == "nuevo", 2).when(F.col("como") == "clave", 1).otherwise(0)).alias("_how"))
    made = one.join(how, "destino").withColumnRenamed("destino", "id").withColumns({"dayNum": D.day_number(F.col("day")), "fuente": F.col("fuentes")[0]})

    compared = [c for c in stored.columns if c not in ("id", "actualizadoAt")]
    print_ = F.sha1(F.to_json(F.struct(*compared)))
    before = stored.select("id", print_.alias("_before"), F.col("actualizadoAt").alias("_at"))
    made = made.withColumn("_print", print_).join(before, "id", "left")
    equal = F.col("_print").eqNullSafe(F.col("_before"))
    made = made.withColumn("actualizadoAt", F.when(equal, F.col("_at")).otherwise(F.lit(at).cast("long"))).withColumn("_como", F.when(equal, "igual").when(F.col("_how") == 2, "nuevo").when(F.col("_how") == 1, "clave").otherwise("id"))
    rest = stored.join(made.select("id"), "id", "left_anti").withColumn("_como", F.lit(None).cast("string"))
    return rest.unionByName(made.select("id", *names, *[c for c in stored.columns if c not in ("id", *names)], "_como"), allowMissingColumns=True)


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, source: str, stream: str, number: int, today: str, at: int) -> dict:
    """Merge the batch's events that are to come into the versioned table at
    root, once for each number of a stream. The run's counters are taken in the
    job that writes: leidas, escritas, nuevas, fusionadas; all 0 for a repeat."""
    counts = {"leidas": 0, "escritas": 0, "nuevas": 0, "fusionadas": 0}
    seen = Observation()

    def change(stored: DataFrame, log: dict) -> tuple[DataFrame | None, dict]:
        nonlocal seen
        done = log.get("lotes", {})
        if number <= done.get(stream, -1):
            return None, {}
        seen = Observation()
        read = batch.where(D.is_future(F.col("day"), today))
        out = merged(stored, read, source, at)
        told = lambda *kinds: F.count_if(F.col("_como").isin(*kinds))
        out = out.observe(seen, told("nuevo", "clave", "id").alias("escritas"), told("nuevo").alias("nuevas"), told("clave").alias("fusionadas"), told("nuevo", "clave", "id", "igual").alias("leidas"))
        return out.drop("_como"), {"lotes": {**done, stream: number}}

    before = V.latest(spark, root)
    if V.update(spark, root, STORED, change) == before:
        return counts
    return counts | seen.get


def sink(root: str, source: str, stream: str, today: str, at: int) -> Callable[[DataFrame, int], None]:
    """apply_batch for writeStream.foreachBatch."""

    def write(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, root, batch, source, stream, number, today, at)

    return write
