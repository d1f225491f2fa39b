"""States of events by batch and by stream, and runs of failures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import lifecycle as C
from almanac.streaming.events import drained

T0 = dt.datetime(2026, 5, 1)
KINDS = f"{C.SIGNAL}, dia date"


def some(rng, n, ids):
    day = lambda i: dt.date(2026, 5, 20 + i % 3)
    rows = []
    for k in range(n):
        i = rng.randrange(ids)
        rows.append((i, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 15)), rng.choice(C.KINDS), f"u{k}", day(i)))
    return rows + rows[:5]


def want(rows):
    by = {}
    for i, at, kind, url, _ in rows:
        by.setdefault(i, []).append((at, kind, url))
    return {i: C.after(v) for i, v in by.items()}


def test_batch_states_equal_a_plain_reading(spark):
    rows = some(random.Random(1), 400, 40)
    got = {r["id"]: (r["estado"], r["posible"], r["motivo"]) for r in C.states(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == want(rows) and {g[0] for g in got.values()} == {"activo", "cancelado"}
    assert C.states(spark.createDataFrame([], KINDS)).count() == 0


@pytest.mark.parametrize("cuts", [1, 5])
def test_stream_states_are_the_same_for_any_batches(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = some(rng, 120, 12)
    rng.shuffle(rows)
    parts = [rows[i::cuts] for i in range(cuts)]
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KINDS).parquet(source)
        # a new query on the same checkpoint each time: it goes on where the last one ended
        q = C.tracked(stream, "40 days").writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/batch-{n}")).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert i or q.lastProgress
    told = spark.read.option("recursiveFileLookup", "true").parquet(base)
    got = {r["id"]: (r["estado"], r["posible"], r["motivo"]) for r in C.newest(told).collect()}
    assert got == want(rows)


def test_state_goes_when_its_day_is_over(spark, tmp_path):
    source = str(tmp_path / "in")
    day = dt.date(2026, 5, 3)
    first = [(1, T0, "cancela", "a", day), (2, T0, "posible", "b", dt.date(2026, 6, 30))]
    later = [(2, T0 + dt.timedelta(days=20), "cancela", "c", dt.date(2026, 6, 30)), (1, T0 + dt.timedelta(days=20), "retoma", "too late", day)]
    out, counts = [], []
    for rows in (first, later, [(3, T0 + dt.timedelta(days=21), "posible", "d", dt.date(2026, 6, 30))]):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(source)
        q = C.tracked(spark.readStream.schema(KINDS).parquet(source)).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))
    closed = [r for r in out if r["cerrado"]]
    assert [(r["id"], r["estado"], r["motivo"]) for r in closed] == [(1, "cancelado", "a")]
    assert {r["id"]: r["estado"] for r in C.newest(spark.createDataFrame(out)).collect()} == {1: "cancelado", 2: "cancelado", 3: "activo"}
    assert counts[-1] == 2


def test_signals_mean_events(spark):
    events = spark.createDataFrame([(1, dt.date(2026, 5, 9), ["A"]), (2, dt.date(2026, 5, 9), ["B", "B"]), (3, dt.date(2026, 5, 10), ["B"]), (4, dt.date(2026, 1, 1), ["A"])], "id long, day date, orquestas array<string>")
    found = spark.createDataFrame([(T0, True, "A", "a"), (T0, True, "B", "b"), (T0, False, "B", "c"), (T0, True, "C", "d")], "at timestamp, cancela boolean, orquesta string, url string")
    got = sorted((r["id"], r["tipo"], r["url"]) for r in C.signals(found, events, "2026-05-01").collect())
    assert got == [(1, "cancela", "a"), (2, "posible", "b"), (2, "retoma", "c"), (3, "posible", "b"), (3, "retoma", "c")]


def test_runs_of_failures_however_they_are_parted(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(6), i, rng.random() < 0.8) for i in range(300)] + [(9, i, True) for i in range(5)] + [(8, 0, False)]
    df = spark.createDataFrame(rows, "k int, i int, f boolean")

    def run(flags):
        return next((n for n, x in enumerate(flags) if not x), len(flags))

    by = {k: [f for kk, _, f in sorted(rows) if kk == k] for k in {r[0] for r in rows}}
    expected = {k: (len(v), run(v), run(v[::-1])) for k, v in by.items()}
    for size in (1, 7, 1000):
        runs = C.failure_runs(df, "k", F.col("i"), F.col("f"), F.floor(F.col("i") / size))
        assert {r["k"]: (r["total"], r["delante"], r["detras"]) for r in C.merged_runs(runs, "k").collect()} == expected
