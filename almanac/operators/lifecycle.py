"""What signals make of events and accounts: called off, possibly so, on again;
and how many readings in a row have failed.

Both are told by windows over all signals, or kept as streaming state; the state
of an event goes when its day is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A signal: the event that it means, when it was seen, its kind (cancela: one
#: event is meant; posible: several are; retoma) and where it was told.
SIGNAL = "id long, at timestamp, tipo string, url string"
STATE = "estado string, posible boolean, motivo string"
KINDS = ("cancela", "posible", "retoma")


def bills(events: DataFrame, today: str) -> DataFrame:
    """(id, orquesta) of events (id, day as date, orquestas) from today on."""
    return events.where(F.col("day") >= F.lit(today).cast("date")).select("id", F.explode(F.array_distinct("orquestas")).alias("orquesta"))


def dispatched(found: DataFrame, bill: DataFrame) -> DataFrame:
    """found (cancela, orquesta and others) with casos, how many events of the
    bill (id, orquesta) the signal may mean, and accion: nuevo without any,
    retoma of a resumption, cancela of one event, ambiguo of several. Events are
    counted by orchestra before signals meet the counts."""
    n = bill.groupBy("orquesta").agg(F.count("*").alias("_n"))
    action = F.when(F.col("_n").isNull(), "nuevo").when(~F.col("cancela"), "retoma").when(F.col("_n") == 1, "cancela").otherwise("ambiguo")
    return found.join(n, "orquesta", "left").withColumns({"casos": F.coalesce("_n", F.lit(0).cast("long")), "accion": action}).drop("_n")


def signals(found: DataFrame, events: DataFrame, today: str) -> DataFrame:
    """(id, at, tipo, url) of signals (at, cancela, orquesta, url): for each event
    (id, day as date, orquestas) from today on with the orchestra on its bill. A
    cancellation is certain where it means one event."""
    bill = bills(events, today)
    kind = F.when(F.col("accion") == "ambiguo", "posible").otherwise(F.col("accion"))
    return dispatched(found, bill).join(bill, "orquesta").select("id", "at", kind.alias("tipo"), "url")


def states(told: DataFrame) -> DataFrame:
    """(id, estado, posible, motivo) after all signals of each event, in order
    of time, kind and address, equal ones once. Calling off sets cancelado; possibly
    calling off marks; resuming undoes both, but only where it is called off."""
    w = Window.partitionBy("id").orderBy("at", "tipo", "url")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    firm = F.when(F.col("tipo") != "posible", F.col("tipo"))
    rows = told.select("id", "at", "tipo", "url").distinct().withColumn("_undone", (F.col("tipo") == "retoma") & (F.coalesce(F.last(firm, True).over(before), F.lit("")) == "cancela"))
    rows = rows.withColumn("_part", F.sum(F.col("_undone").cast("int")).over(w))
    order = F.struct("at", "tipo", "url")
    parts = rows.groupBy("id", "_part").agg(F.max(F.when(firm.isNotNull(), F.struct(order, firm.alias("k")))).alias("_firm"), F.max(F.when(F.col("tipo") == "posible", F.lit(1))).alias("_p"), F.max(F.when(F.col("tipo") != "retoma", order)).alias("_why"))
    last = parts.groupBy("id").agg(F.max(F.struct("_part", "_firm", "_p", "_why")).alias("s"))
    off = F.coalesce(F.col("s._firm.k") == "cancela", F.lit(False))
    return last.select("id", F.when(off, "cancelado").otherwise("activo").alias("estado"), F.col("s._p").isNotNull().alias("posible"), F.col("s._why.url").alias("motivo"))


def after(rows: list[tuple]) -> tuple[str, bool, str | None]:
    """The state after these (at, tipo, url), in order."""
    state, marked, why = "activo", False, None
    for _, kind, url in sorted(set(rows)):
        if kind == "cancela":
            state, why = "cancelado", url
        elif kind == "posible":
            marked, why = True, url
        elif state == "cancelado":
            state, marked, why = "activo", False, None
    return state, marked, why


def tracked(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of signals with the dia of their event (a date) as a stream of
    (id, n, estado, posible, motivo, cerrado): the state after the n signals seen so
    far. Signals that come out of order are sorted in, so that the last state is that
    of states() however the stream is cut into batches. At the end of its day an
    event is closed and its state dropped; later signals of it are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def out(rows: list[tuple], closed: bool) -> pd.DataFrame:
            return pd.DataFrame([(key[0], len(rows), *after(rows), closed)], columns=["id", "n", "estado", "posible", "motivo", "cerrado"])

        have = list(zip(*state.get, strict=True)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield out(have, True)
            return
        rows, end = set(have), None
        for pdf in batches:
            for at, kind, url, day in zip(pdf["at"], pdf["tipo"], pdf["url"], pdf["dia"], strict=True):
                end = (pd.Timestamp(day) + pd.Timedelta(days=1)).value // 1_000_000
                rows.add((at.value // 1_000, kind, url))
        if end is None or end <= state.getCurrentWatermarkMs():
            return
        kept = sorted(rows)
        state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        state.setTimeoutTimestamp(end)
        yield out(kept, False)

    timely = stream.where((F.to_date("at") <= F.col("dia")) & F.col("id").isNotNull() & F.col("at").isNotNull() & F.col("tipo").isin(*KINDS))
    told = timely.select("id", F.col("at").cast("timestamp").alias("at"), "tipo", F.coalesce("url", F.lit("")).alias("url"), "dia").withWatermark("at", late)
    return told.groupBy("id").applyInPandasWithState(step, f"id long, n long, {STATE}, cerrado boolean", "at array<long>, tipo array<string>, url array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def newest(tracked_rows: DataFrame) -> DataFrame:
    """(id, estado, posible, motivo) of the last that a stream told of each."""
    return tracked_rows.groupBy("id").agg(F.max_by(F.struct("estado", "posible", "motivo"), F.struct("n", "cerrado")).alias("s")).select("id", "s.*")


# ------------------------------------------------------- readings that fail
RUN = "total long, delante long, detras long"


def failure_runs(readings: DataFrame, key: str, order: Column, failed: Column, block: Column) -> DataFrame:
    """(key, block, total, delante, detras): of the readings of each key in each
    block of time how many there are, and how many failed before the first and
    after the last that did not. A frequent key is spread over its blocks."""
    rows = readings.select(F.col(key), block.alias("block"), order.alias("_o"), F.coalesce(failed, F.lit(False)).alias("_f"))
    good = F.when(~F.col("_f"), F.col("_o"))
    ends = rows.groupBy(key, "block").agg(F.min(good).alias("_first"), F.max(good).alias("_last"))
    met = rows.join(ends, [key, "block"])
    none = F.col("_first").isNull()
    return met.groupBy(key, "block").agg(F.count("*").alias("total"), F.count_if(none | (F.col("_o") < F.col("_first"))).alias("delante"), F.count_if(none | (F.col("_o") > F.col("_last"))).alias("detras"))


def merged_runs(runs: DataFrame, key: str, by: str = "block") -> DataFrame:
    """(key, total, delante, detras) of summaries that follow each other: a block
    where all failed lengthens the run before it. Summaries of parts give that of
    the whole, however it was parted."""
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("total", "delante", "detras")])

    def add(a: Column, b: Column) -> Column:
        front = F.when(a["delante"] == a["total"], a["delante"] + b["delante"]).otherwise(a["delante"])
        back = F.when(b["detras"] == b["total"], a["detras"] + b["detras"]).otherwise(b["detras"])
        return F.struct((a["total"] + b["total"]).alias("total"), front.alias("delante"), back.alias("detras"))

    lists = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(by, "total", "delante", "detras"))).alias("_l"))
    return lists.select(key, F.aggregate("_l", start, add).alias("_s")).select(key, "_s.*")
