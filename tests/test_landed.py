"""Cases of posters and landed pages."""

from __future__ import annotations

import time

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import posters
from almanac.sources import pages as P


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SÁBADO 5 de septiembre\n23:00 Verbena popular\nDomingo\nGran baile de fin", [(0, "05-09-2026", "23:00"), (1, "06-09-2026", "")]),
        ("Viernes 28\nVerbena de apertura\nSábado 5\nVerbena final del barrio", [(0, "28-08-2026", ""), (1, "05-09-2026", "")]),
        ("Verbena hasta el sábado 27\nGran verbena", []),
        ("Sábado 2 de enero\nVerbena de Reyes\nmartes 5\nVerbena grande", [(0, "02-01-2027", ""), (1, "05-01-2027", "")]),
        ("Sábado 21:30 Verbena en la plaza", [(0, "22-08-2026", "21:30")]),
        ("Sábado 31 de junio\nVerbena que no es\nlunes\nVerbena del lunes", [(1, "24-08-2026", "")]),
        ("", []),
        (None, []),
    ],
)
def test_poster_acts(spark, text, want):
    df = spark.createDataFrame([(1, text, dt.date(2026, 8, 20))], "id int, t string, r date")
    got = sorted((r["ord"], r["day"], r["hora"]) for r in posters.poster_acts(df, "id", "t", "r").collect())
    assert got == want


def test_sheets_and_days(spark):
    df = spark.createDataFrame([("septiembre 11 @ 9:00 am", "25 y 26 de abril y 1 de mayo"), ("a las 11:30 p.m.", "31 de abril"), ("12:15 am", ""), (None, None)], "h string, t string")
    got = [(r[0], r[1]) for r in df.select(P.sheet_hour(F.col("h")), P.title_days(F.col("t"), F.lit(2026))).collect()]
    assert got == [("09:00", ["25-04-2026", "26-04-2026", "01-05-2026"]), ("23:30", []), ("00:15", []), ("", None)]


def test_lists_in_answers():
    assert P.longest_list('x [1] [{"indice": 1}] [{"indice": 2, "a": [3]}] [', "indice") == '[{"indice": 2, "a": [3]}]'
    assert P.longest_list('[{"indice": "1"}]', "indice") is None and P.longest_list(None, "indice") is None and P.longest_list("[[[", "indice") is None
    began = time.time()
    assert P.longest_list("[" * 200_000 + '{"indice": 1}', "indice") is None and P.longest_list('[{"a":' * 5_000, "indice") is None
    assert P.longest_list('text [{"nota": "x [" } ' * 3_000 + '[ {"indice": 7}]', "indice") == '[ {"indice": 7}]' and time.time() - began < 3


def test_pages_without_anything(spark):
    df = spark.createDataFrame([("https://x.com/a", None), ("u", ""), ("u", "<table><tr><td>Fecha</td><td>a</td><td>b</td><td>c</td></tr></table>")], "url string, html string")
    assert P.agenda_tables(df).count() == 0 and P.public_posts(df).count() == 0
    one = spark.createDataFrame([("u", "<tr><td>1</td><td>a</td><td>b</td><td>c</td></tr>")], "url string, html string")
    assert [(r["mes"], r["anyo"], r["fecha"]) for r in P.agenda_tables(one).collect()] == [("", "", "1")]
