from __future__ import annotations

import random

from pyspark.sql import functions as F

from almanac.operators import lifecycle as C
from almanac.operators import matching as X
from almanac.operators import status as U


def test_totals_of_no_rows_and_of_null_names(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 5), (None, "x", None)], "m string, f string, v long")
    got = {tuple(r) for r in U.totals(df, [["m"], ["m", "f"], []], grandes=F.col("v") > 2).collect()}
    assert got == {("", None, None, 3, 1), ("m", "a", None, 2, 1), ("m", None, None, 1, 0), ("m,f", "a", "x", 1, 0), ("m,f", "a", None, 1, 1), ("m,f", None, "x", 1, 0)}
    assert U.totals(df.limit(0), [["m"], []]).count() == 0
    known = spark.createDataFrame([("x", 1), ("y", 2)], "fuente string, rango int")
    rows = df.select(F.col("f").alias("fuente"))
    assert {tuple(r) for r in U.sources(rows, known).collect()} == {("x", 1, 2, True), ("y", 2, 0, False)}


def test_alerts_that_wait(spark):
    df = spark.createDataFrame([("programa-pdf", None), ("programa-pdf", True), ("pdf-escaneado", False), ("fallo", False), (None, None)], "t string, leido boolean")
    assert [r[0] for r in df.select(U.is_pending(F.col("t"), F.col("leido"))).collect()] == [True, False, True, False, False]


def test_ranks_go_on_from_partition_to_partition(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.choice([None, 1, 2, 3]), rng.choice([None, 4, 5])) for _ in range(900)] + [(1000, 3, 4)] * 3
    df = spark.createDataFrame(rows, "id long, score int, dias int")
    rank = lambda r: (-(r[1] if r[1] is not None else -1), r[2] if r[2] is not None else 99, r[0])
    best = sorted({min((r for r in rows if r[0] == i), key=rank) for i in {r[0] for r in rows}}, key=rank)
    want = [(*r, n + 1) for n, r in enumerate(best)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert sorted(map(tuple, X.ranked(df).collect()), key=lambda r: r[3]) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert X.ranked(df.limit(0)).count() == 0
    assert {r["puesto"] for r in X.ranked(df, "score").where("score = 3").collect()} == set(range(1, 1 + sum(r[1] == 3 for r in best)))


def test_signals_without_and_with_events(spark):
    found = spark.createDataFrame([(True, "uno"), (True, "dos"), (True, "tres"), (False, "dos"), (False, "tres"), (None, "uno"), (True, None)], "cancela boolean, orquesta string")
    bill = spark.createDataFrame([(1, "uno"), (2, "dos"), (3, "dos")], "id long, orquesta string")
    got = {tuple(r) for r in C.dispatched(found.where("cancela IS NOT NULL"), bill).select("cancela", "orquesta", "casos", "accion").collect()}
    assert got == {(True, "uno", 1, "cancela"), (True, "dos", 2, "ambiguo"), (True, "tres", 0, "nuevo"), (False, "dos", 2, "retoma"), (False, "tres", 0, "nuevo"), (True, None, 0, "nuevo")}
