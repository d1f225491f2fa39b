"""Cases of the domain functions, from the fixtures' list."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import programmes as P
from almanac.operators import social as S
from almanac.operators.scoring import scored


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("21.30h", "21:30h"), ("09.00 horas", "09:00 horas"), ("v2.0", "v2.0"), ("3.50 e", "3.50 e")])
def test_hours(spark, text, want):
    assert one(spark, T.hours(F.col("t")), t=text) == want


def test_entities(spark):
    assert one(spark, T.entities(F.col("t")), t="a&#233;b&#xE9;&#128512; &#x110000; &ntilde;&amp;") == "aébé😀 &#x110000;  &"
    assert one(spark, T.entities(F.col("t")), t="&#;&#12") == "&#;&#12"


def test_rites_need_music_and_mentions_lift_vetoes(spark):
    rows = [("Baile de la Virgen", "", 0), ("Baile de la Virgen", "con parranda", 0), ("Verbena", "misa y " + "x" * 600 + " amenizado", 0), ("Verbena", "misa", 0), ("Verbena", "misa", 6), ("Verbena Sabrosa", "Sabrosa y Falete", 0)]
    df = spark.createDataFrame(rows, "t string, d string, e int")
    got = scored(df, S.event_rules(["Sabrosa", "Falete"], F.col("t"), F.col("d"), F.lit(""), F.lit(""), F.col("e"))).collect()
    assert [r["score"] for r in got] == [-3, 3, 3, 0, 9, 13]


def test_days_and_months(spark):
    assert [one(spark, D.is_future(F.col("d"), "2026-09-13"), d=d) for d in ("13-09-2026", "12-09-2026", "", "x")] == [True, False, True, True]
    assert [one(spark, D.day_number(F.col("d")), d=d) for d in ("05-10-2026", "", "31-02-2026")] == [20261005, 0, 0]
    assert [one(spark, D.month_number(F.col("d")), d=d) for d in ("setiembre", "enero", "foo")] == ["09", "01", ""]


@pytest.mark.parametrize(("title", "kind"), [("Baile de Magos", "Baile Magos"), ("Tardeo", "Baile Normal"), ("Noche en Blanco", "Concierto"), ("Fiestas de X", "Fiestas"), ("Romería", "Romería"), ("Charla", "Otro")])
def test_kinds(spark, title, kind):
    assert one(spark, S.event_kind(F.col("t")), t=title) == kind


def test_scores_explain_themselves(spark):
    rows = [("Gran Verbena", "", "", ""), ("Gran Verbena", "", "23:00", "Plaza X"), ("Taller infantil de baile", "", "", ""), ("Noche con La Sabrosa", "", "", ""), ("Misa", "Rosario", "", "")]
    df = spark.createDataFrame(rows, "t string, d string, h string, p string")
    got = scored(df, S.event_rules(["Sabrosa"], F.col("t"), F.col("d"), F.col("h"), F.col("p"))).collect()
    assert [(r["score"], r["aceptado"]) for r in got] == [(3, False), (5, True), (-6, False), (5, True), (-8, False)]
    assert got[1]["motivos"] == ["titulo: gran verbena", "noche", "lugar: Plaza X"]


@pytest.mark.parametrize(("told", "days"), [("3 h", 0), ("20 min", 0), ("ayer", 1), ("4 d", 4), ("2 sem", 14), ("2 semanas", 14), ("20 minutos", 0), ("3 horas", 999), ("2 días", 2), ("hace 5 d y 2 sem", 5), ("15 de ago.", 29), ("20 de dic.", 267), ("", 999)])
def test_post_ages(spark, told, days):
    assert one(spark, S.post_age(F.col("t"), F.col("r")), t=told, r=dt.date(2026, 9, 13)) == days


@pytest.mark.parametrize(
    ("text", "day"),
    [("esta noche", "2026-09-16"), ("mañana baile", "2026-09-17"), ("pasado mañana", "2026-09-18"), ("este finde", "2026-09-19"), ("el sábado", "2026-09-19"), ("el miércoles", "2026-09-23"), ("este viernes", "2026-09-18"), ("hasta el miércoles 23", None), ("10 de enero", "2026-01-10"), ("10 de enero del proximo", "2026-01-10"), ("3 de octubre", "2026-10-03"), ("El viernes gran verbena; esta noche ensayo", "2026-09-16"), ("el lunes y este domingo", "2026-09-20")],
)
def test_event_days(spark, text, day):
    got = one(spark, S.event_day(F.col("t"), F.col("p")), t=text, p=dt.date(2026, 9, 16))
    assert (got and got.isoformat()) == day


def test_line_ups(spark):
    assert P.names_of("Orquesta La Sabrosa y Nueva Línea") == ["Sabrosa y Nueva Línea"]
    assert set(P.names_of("Verbena con el Grupo Pati, Atenia y la Orquesta Olimpia")) == {"Pati", "Atenia", "Olimpia"}
    assert P.names_of("Verbena amenizada por las orquestas Uno, Dos y Tres. Fuegos") == ["Uno", "Dos", "Tres"]
    assert P.names_of("Actuación de: Grupo Alma, DJ Rayo y Parranda Sur (gratis)") == ["Alma", "Rayo", "Sur"]
    assert P.names_of("Baile con la Orquesta Malibú, Plaza del Pueblo") == ["Malibú"] and P.names_of("Gala con Pepe en la Plaza") == ["Pepe"]
    assert P.names_of("Baile con entrega de premios") == [] and P.names_of(None) == []
    df = spark.createDataFrame([(1, "Sábado 3 baile. Domingo 4 gala"), (2, None)], "id int, t string")
    assert df.select(P.line_up(F.col("t"))).count() == 2


def test_images_and_verdicts(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"<html>"),)], "c binary")
    assert [r[0] for r in df.select(S.is_image(F.col("c"))).collect()] == [True, True, False]
    df = spark.createDataFrame([(1, None, False), (3, None, False), (4, None, False), (5, None, True), (2, True, True), (5, False, True)], "s int, r boolean, seen boolean")
    assert [r[0] for r in df.select(S.verdict(F.col("s"), F.col("r"), F.col("seen"))).collect()] == [False, False, True, False, True, False]
