"""Cases of page indexes, places, alerts, accounts and the backed-up dedup batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import places as P
from almanac.operators import store as K
from almanac.sources import indexes as I

BASE = "https://b.es"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Plaza Andrés de Lorenzo Cáceres Gran concierto del cantante", "Plaza Andrés de Lorenzo Cáceres"),
        ("Plaza Andrés de Lorenzo Cáceres 13:30h – Actuación", "Plaza Andrés de Lorenzo Cáceres"),
        ("Auditorio Municipal de Santa Cruz", "Auditorio Municipal de Santa Cruz"),
        ("Cancha El Lomo", "Cancha El Lomo"),
        ("", ""),
    ],
)
def test_prose_after_a_name(spark, name, want):
    assert one(spark, P.venue_name(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    ("text", "before", "after"),
    [
        ("En la Plaza de la Pila. Gran verbena, en el Recinto Ferial.", "Plaza de la Pila", "Recinto Ferial"),
        ("Salida desde la Plaza Mayor hasta el muelle. Gran verbena en la plaza de carcajadas", "", ""),
        ("Cancha Uno hasta Dos, Casco de Tegueste. Gran verbena", "Casco de Tegueste", ""),
        ("Parque Uno sin el título", "Parque Uno sin el título", ""),
        ("Gran verbena", "", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_venues(spark, text, before, after):
    title = F.lit("Gran verbena")
    assert one(spark, P.place_before(F.col("t"), title), t=text) == before
    assert one(spark, P.place_after(F.col("t"), title), t=text) == after


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Benijos, La Orotava, San Isidro 2026", "La Orotava"),
        ("Barranco, Los Realejos, San Miguel de Abona", "Los Realejos"),
        ("Pino Santo, Otra, La Orotava", None),
        ("La Orotava, El Hierro", None),
        ("", None),
        (None, None),
    ],
)
def test_municipality_of_a_headline(spark, title, want):
    assert one(spark, P.municipality(F.col("t"), ["La Orotava", "Los Realejos", "San Miguel de Abona"], ["El Hierro"]), t=title) == want


@pytest.mark.parametrize(
    ("url", "name", "want"),
    [
        ("https://x.com/fiestas.dellano", "Fiestas de la Cruz", "Cruz"),
        ("https://x.com/a/villa-alta/", "", "villa alta"),
        ("https://x.com/a", "Comisión de Fiestas del Llano", "Llano"),
        ("https://x.com/a", "Fiestero", "Fiestero"),
        (None, None, ""),
    ],
)
def test_account_place(spark, url, name, want):
    assert one(spark, P.account_place(F.col("u"), F.col("n")), u=url, n=name) == want


def test_core_of_an_address(spark):
    core = lambda text, url: one(spark, P.slug_core(F.col("t"), F.col("u"), F.lit("Granadilla"), ["fiestas"]), t=text, u=url)
    assert core("Fiestas de El Médano y más", "https://b.es/p/fiestas-medano-2026") == "El Médano"
    assert core("Fiestas de El Médano", "https://b.es/p/fiestas-medano-luz-2026") == ""
    assert core("Otra cosa", "https://b.es/p/fiestas-medano/") == "" and core(None, None) == "" and core("", "https://b.es/p/a+b(c") == ""


def test_titles_and_rules(spark):
    assert one(spark, T.clean_title(F.col("t")), t="| **Gran**\n `verbena` ↓") == "Gran verbena" and one(spark, T.clean_title(F.col("t")), t=None) == ""
    assert one(spark, T.rewritten(F.col("t"), T.PROGRAMME), t="SÁBAD O 19 y SEPTIEMBRE\nMARTES 1, 11 JUl 22:00 H") == "SÁBADO 19 y MARTES 1 DE SEPTIEMBRE, 11 julio 22:00"
    assert one(spark, T.says(F.col("t"), F.lit("medano")), t="En El Médano.") is True and one(spark, T.says(F.col("t"), F.lit("meda")), t="El Médano") is False


def test_indexes_without_anything(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<a>x</a><a href=''></a>")], "pag int, html string")
    assert I.anchors(pages, BASE).count() == 0 and I.cards(pages, BASE).count() == 0
    months = pages.select(F.lit(2026).alias("anyo"), F.lit(1).alias("mes"), "pag", "html")
    assert I.month_archives(months, BASE).count() == 0 and I.month_archives(months.limit(0), BASE).count() == 0
    assert one(spark, I.year_of(F.col("u"), F.col("h"), F.lit(2026)), u=None, h=None) == "2026"
    assert one(spark, I.chip_year(F.col("c"), F.col("t"), F.lit(2026)), c=None, t=None) == "2026"


def test_an_archive_ends_when_enough_are_found(spark):
    link = lambda p, i: f'<a href="{BASE}/2026/{p}-{i}.html">Programa de las fiestas {i}</a>'
    rows = [(2026, 9, p, "".join(link(p, i) for i in range(25))) for p in (1, 2, 3)] + [(2026, 10, 2, link(2, 0))]
    found = I.month_archives(spark.createDataFrame(rows, "anyo int, mes int, pag int, html string"), BASE)
    assert found.count() == 50 and {r["mes"] for r in found.collect()} == {9}


def test_first_links(spark):
    html = "".join(f'<a href="/n{i % 3}">Gran verbena de todos {i}</a>' for i in range(6))
    found = I.anchors(spark.createDataFrame([(1, html)], "pag int, html string"), BASE, most=2).collect()
    assert sorted((r["url"], r["titulo"]) for r in found) == [(f"{BASE}/n0", "Gran verbena de todos 0"), (f"{BASE}/n1", "Gran verbena de todos 1")]


def test_ring_of_alerts(spark):
    columns = "municipio string, tipo string, url string, at long, detalle string"
    stored = spark.createDataFrame([("a", "t", "u", 1, "x", 1), ("b", "t", "u", 2, "x", 2)], f"{columns}, primero long")
    fresh = spark.createDataFrame([("a", "t", "u", 5, "y"), ("c", "t", "u", 6, "z")], columns)
    got = {r["municipio"]: (r["at"], r["detalle"], r["primero"]) for r in K.alerts(stored, fresh).collect()}
    assert got == {"a": (5, "y", 1), "b": (2, "x", 2), "c": (6, "z", 6)}
    assert {r["municipio"] for r in K.alerts(stored, fresh, most=2).collect()} == {"b", "c"}


def test_dedup_with_a_backup(spark, tmp_path):
    columns = "id string, hora string, day string, municipio string, lugar string, fuente string, titulo string, orquestas array<string>, score int, clave string, fuentes array<string>, estado string"
    row = lambda i, hora: (i, hora, "01-01-2026", "M", "L", "F" + i, "Verbena", ["o"], 1, None, None, None)
    path = str(tmp_path / "t")
    spark.createDataFrame([row("a", ""), row("b", "21:00"), row("c", "")], columns).write.parquet(path)
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "id string, grupo string")
    report = K.apply_dedup(spark, path, groups, "2026-01-01")
    assert [(r["grupo"], r["ids"], r["n"]) for r in report.collect()] == [("g", ["a", "b"], 2)] and spark.read.parquet(path).count() == 3
    again = K.apply_dedup(spark, path, groups, "2026-01-01", dry=False).collect()
    assert len(again) == 1 and {r["id"] for r in spark.read.parquet(path).collect()} == {"b", "c"}
    assert spark.read.parquet(f"{path}.backup-2026-01-01-0001").count() == 3


def test_dedup_keeps_columns_and_what_was_written_between_two_passes(spark, tmp_path):
    columns = "id int, hora string, day string, municipio string, lugar string, fuente string, titulo string, orquestas array<string>, score int, url string, fotos array<string>, dayNum int, posibleCancelacion boolean"
    row = lambda i, hora, url, fotos: (i, hora, "01-01-2026", "M", "L", "F", "Verbena", ["o"], i, url, fotos, 20260101, i == 2)
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), columns)
    frame(row(1, "21:00", None, None), row(2, "", "u2", ["f2"])).write.parquet(path)
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id int, grupo int")
    K.apply_dedup(spark, path, groups, "2026-01-01", dry=False)
    (kept,) = spark.read.parquet(path).collect()
    assert (kept["id"], kept["url"], kept["fotos"], kept["dayNum"], kept["posibleCancelacion"], kept["score"]) == (1, "u2", ["f2"], 20260101, False, 2)
    K.replace(K.upsert(spark.read.parquet(path), frame(row(9, "", "u9", []))), path)
    K.apply_dedup(spark, path, groups, "2026-01-01", dry=False)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 9]
    assert [spark.read.parquet(f"{path}.backup-2026-01-01-000{n}").count() for n in (1, 2)] == [2, 2]
