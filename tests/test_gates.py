"""Cases of gates, of text mending and of store changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from almanac.operators import gates as G
from almanac.operators import layout as L
from almanac.operators import store as K


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return [r["x"] for r in df.select(column.alias("x")).collect()]


@pytest.mark.parametrize(
    ("column", "values", "want"),
    [
        (lambda t: L.mended_weekdays(t), ["SáBano 10", "sabana 10", "viernez 21:30", "DoMinco 11 y Lunes 12", "", None], ["Sábado 10", "sabana 10", "viernez 21:30", "Domingo 11 y Lunes 12", "", None]),
        (lambda t: L.mended_weekdays(t), ["marte 3, juevess 4", "mercoles 5", "domino 6 domingos 7 dominhos 8", "sabadoo 9 sábado 10"], ["martes 3, jueves 4", "mercoles 5", "domingo 6 domingo 7 dominhos 8", "sábado 9 sábado 10"]),
        (lambda t: L.hour_with_act(t), ["21:00 h – Plaza X\nGran baile", "21:00 h - Plaza X\nviernes 3", "21:00 baile", None], ["21:00 - Gran baile (Plaza X)", "21:00 h - Plaza X\nviernes 3", "21:00 baile", None]),
        (lambda t: L.hour_with_act(t), ["9:30 horas. – Casa Vieja\n“Gala”\nfin", "21:00 h – A.B\nGala", "21:00 h – Uno\n22:00 h – Dos\nTres", "x\n21:00 h – Plaza"], ["9:30 - “Gala” (Casa Vieja)\nfin", "21:00 h – A.B\nGala", "21:00 - 22:00 h – Dos (Uno)\nTres", "x\n21:00 h – Plaza"]),
        (lambda t: L.page_number(t), ["a/page-07.jpg", "a/PAG_12-3.jpg", "x/033.png", "x/a.png", None], [7, 12, 33, 0, 0]),
        (lambda t: L.page_number(t), ["https://a.es/p_0123.png", "map12-07.webp", "a/2026/x.jpg", "pag-1.jpg", "x12345.png"], [123, 12, 0, 0, 2345]),
        (lambda t: L.month_in_slug(t), ["Navidad-enero", "fiesta-mayo", "x", None], [12, 5, -1, -1]),
        (lambda t: L.article_body(t), ["<nav>a</nav><h1 class='x'>b</h1>", '<p>a</p><h1 class="post-title">B</h1><p>c</p><a class="share-post">d</a>', "", None], ["a\nb", "B\nc", "", None]),
        (lambda t: G.says_something(t, ["wamampy"]), ["~~ |", "Con WAMAMPY", "a las 9:30", "verbenas", None], [False, True, True, True, False]),
        (lambda t: G.is_read("auto", t, F.lit(False)), ["abandonada", "fria", "", None], [False, True, True, True]),
        (lambda t: G.is_read("caliente", t, F.lit(True)), ["abandonada", "caliente", "", None], [False, True, True, True]),
        (lambda t: G.is_fresh(t.cast("int")), ["7", "8", None], [True, False, False]),
        (lambda t: G.is_poster(t, "2026"), ["https://a/2026/Fiesta.JPG?x", "a/2026/fiesta.jpg", "https://a/2025/fiesta.jpg", None], [True, False, False, False]),
        (lambda t: G.is_entity(t, F.lit("Ana"), "x.com", own="yo"), ["https://www.x.com/ana", "https://x.com/yo", "https://y.com/ana", "https://x.com/help/a", "https://x.com/ana/photos", None], [True, False, False, False, False, False]),
        (lambda t: G.is_opened(t, F.lit(None).cast("boolean"), ["la villa"]), ["Fiestas de X", "En La Villa", "La Villanueva", None], [True, True, False, False]),
        (lambda t: G.is_elsewhere(t, ["la palma"]), ["Baile en La Palma", "la palmera", None], [True, False, False]),
    ],
)
def test_columns(spark, column, values, want):
    assert each(spark, column(F.col("t")), values) == want


def test_years(spark):
    rows = [("/2021/a", "2030"), ("/a", '<meta property="article:published_time" content="2022-01-01">'), ("/a", "3 Marzo, 2023"), (None, None)]
    df = spark.createDataFrame(rows, "u string, h string")
    assert [r[0] for r in df.select(L.year_of(F.col("u"), F.col("h"), 2026)).collect()] == [2021, 2022, 2023, 2026]


def test_venue_bullets(spark):
    df = spark.createDataFrame([(1, "Día. • Plaza Alta. Baile • Casa. Gala"), (2, "sin marcas"), (3, None)], "id int, texto string")
    got = [tuple(r) for r in L.by_place(df).orderBy("id", "parte").collect()]
    assert got == [(1, 0, "Plaza Alta", "• Plaza Alta. Baile "), (1, 1, "Casa", "• Casa. Gala"), (2, 0, "", "sin marcas"), (3, 0, "", "")]


def test_columns_read_across(spark):
    kinds = "id int, ord int, day string, {} array<string>"
    acts = spark.createDataFrame([(1, 0, "a", []), (1, 2, "b", []), (1, 3, "c", []), (2, 0, "d", ["own"])], kinds.format("orquestas"))
    sections = spark.createDataFrame([(1, 1, "next", ["N"]), (1, 3, "no", ["M"]), (1, 4, "", ["O"]), (2, 1, "x", ["P"])], kinds.format("nombres"))
    got = sorted((r["id"], r["ord"], r["day"], r["orquestas"]) for r in L.across_columns(acts, sections).collect())
    assert got == [(1, 0, "next", ["N"]), (1, 2, "b", []), (1, 3, "c", []), (2, 0, "d", ["own"])]


def test_covered_texts(spark):
    texts = spark.createDataFrame([(1, "gran baile plaza mayor sabado"), (1, "otra cosa distinta"), (2, "gran baile"), (1, None)], "municipio int, texto string")
    known = spark.createDataFrame([(1, "Gran BAILE en la plaza mayor"), (1, "gran baile"), (2, "")], "municipio int, texto string")
    assert sorted((r[0], r[1] or "") for r in G.covered(texts, known).collect()) == [(1, ""), (1, "otra cosa distinta"), (2, "gran baile")]


def test_deduplicated_store(spark):
    kinds = "id int, titulo string, day string, hora string, municipio string, lugar string, fuente string, orquestas array<string>, fuentes array<string>, clave string, estado string, score int"
    rows = [(1, "Baile largo", "d", "", "m", "", "a", ["X"], None, None, None, 3), (2, "Baile", "d", "22:00", "m", "", "b", ["Y"], ["c"], "k", "oculto", 1), (3, "Solo", "d", "", "M", "", None, [], None, None, None, 0)]
    stored = spark.createDataFrame(rows, kinds)
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id int, grupo int")
    got = {r["id"]: r for r in K.deduplicated(stored, groups).collect()}
    assert sorted(got) == [2, 3]
    assert (got[2]["titulo"], got[2]["hora"], got[2]["orquestas"], got[2]["fuentes"], got[2]["score"], got[2]["clave"], got[2]["estado"]) == ("Baile largo", "22:00", ["X", "Y"], ["a", "b", "c"], 3, "k", "oculto")
    assert (got[3]["clave"], got[3]["estado"], got[3]["fuentes"]) == ("m|d|solo", "activo", [])
    assert K.deduplicated(stored.limit(0), groups).count() == 0


def test_states_and_conflicts(spark):
    stored = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, "x", False)], "id int, estado string, posibleCancelacion boolean")
    signals = spark.createDataFrame([(1, 1, True, False), (1, 2, False, True), (2, 5, True, False)], "id int, at int, cancela boolean, retoma boolean")
    got = sorted(tuple(r) for r in K.with_states(stored, signals).collect())
    assert got == [(1, "activo", False), (2, "x", True), (3, "x", False)]
    accounts = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "id int, handle string")
    assert [r["id"] for r in K.conflicts(accounts).collect()] == [2]
