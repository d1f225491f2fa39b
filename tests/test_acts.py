from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from almanac.operators import acts as A
from almanac.operators import places as P
from almanac.operators import programmes as R
from almanac.operators.spans import cut


def sections(spark, text, *ref):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r["dia"], r["mes"], r["anyo"], r["texto"]) for r in R.sections(df, "id", "t", *map(F.lit, ref)).orderBy("ord").collect()]


SECTIONS = [
    ("Viernes 11 de septiembre: baile. 18 Viernes, gala", (), [(11, "09", ""), (18, "", "")]),
    ("7 de agosto: cena\nel día 25 de abril de 2026 verbena", (), [(7, "08", ""), (25, "04", "2026")]),
    ("inscripción (hasta el 10 de septiembre)", (), []),
    (None, (), []),
    ("24 25 Jueves actos", ("06", "2026"), [(25, "", "")]),
    ("24 26 Jueves actos", ("06", "2026"), []),
    ("13 14 Domingo 21 gala", ("06", "2026"), [(14, "", "")]),
    ("13 15 Domingo 21 gala", ("06", "2026"), [(21, "", "")]),
    ("SÁBADO 3 Sábado 10", (), [(3, "", ""), (10, "", "")]),
    ("Viernes 21:30 baile", (), []),
    ("antes del día 5 de mayo", (), []),
    ("a las 7 de agosto", (), []),
    ("7 - 9 de agosto\n30 de agosto: fin", (), [(7, "08", ""), (30, "08", "")]),
    ("Jueves 3 septiembre 18:00 misa", (), [(3, "09", "")]),
    ("Domingo 30 aniversario", (), [(30, "", "")]),
    ("MIÉRCOLES, 8 DE SETIEMBRE DE 2027", (), [(8, "09", "2027")]),
    ("viernes 32 baile", (), []),
    ("plazo: del el 3 de mayo; el 4 de mayo gala", (), [(4, "05", "")]),
]


def test_sections(spark):
    rows = [(i, text, *(ref or (None, None))) for i, (text, ref, _) in enumerate(SECTIONS)]
    df = spark.createDataFrame(rows, "id int, t string, m string, y string")
    got = {i: [] for i in range(len(rows))}
    for r in R.sections(df, "id", "t", F.col("m"), F.col("y")).orderBy("id", "ord").collect():
        got[r["id"]].append((r["dia"], r["mes"], r["anyo"]))
    assert got == {i: want for i, (_, _, want) in enumerate(SECTIONS)}


def test_slow_parts_of_a_pattern_come_after_cheap_ones():
    assert R._THE.index("el") < R._THE.index("(?<!") and R._LEAD.startswith("(?:(?=a)")  # looking back only where "el" or "a" stands


def test_folded_once_is_folded_word_by_word():
    slow = lambda t: "".join(c if len(c) == 1 else " " for c in map(str.lower, t)).translate(R._FOLD)
    for t in ("", "Verbena ÑANDÚ", "İstanbul con Grupo Pati", "ΟΔΟΣ ΟΔΟΣ", "ẞ É"):
        assert R.folded(t) == slow(t) and len(R.folded(t)) == len(t)


def test_what_leads_to_a_day_belongs_to_it(spark):
    got = sections(spark, "Viernes 25 misa. A su término BAILE POPULAR. 26 Sábado gala")
    assert got[0][3] == "Viernes 25 misa. " and got[1][3] == "A su término BAILE POPULAR. 26 Sábado gala"
    assert [s[3] for s in sections(spark, "intro. Lunes 3 a su término nada. Martes 4 fin")] == ["Lunes 3 a su término nada. ", "Martes 4 fin"]
    text = "x " * 5000 + "Lunes 3 uno " * 400
    df = spark.createDataFrame([(1, text), (2, "Sábado 3 baile. Domingo 4 gala"), (3, None)], "id int, t string")
    rows = R.sections(df, "id", "t").collect()
    assert sum(r["id"] == 1 for r in rows) == 400 and all(text[r["pos"] :].startswith(r["texto"]) for r in rows if r["id"] == 1)
    assert [(r["id"], r["ord"], r["dia"]) for r in sorted(rows) if r["id"] != 1] == [(2, 0, 3), (2, 1, 4)]


def acts(spark, text, names=()):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return A.acts(df, "id", "t", names).orderBy("ord", "n").collect()


def test_acts_have_hour_place_and_names(spark):
    got = acts(spark, "Lunes 3 de mayo\n20:00 misa. 21:30 Gran verbena con Grupo Pati y Atenia en la Plaza de San Marcos. 23:00 Baile de magos", ["Olimpia"])
    assert [(a["hora"], a["titulo"][:12]) for a in got] == [("21:30", "Gran verbena"), ("23:00", "Baile de mag")]
    assert got[0]["orquestas"][0] == "Pati" and got[0]["lugar"] == "Plaza de San Marcos"
    assert [a["orquestas"] for a in acts(spark, "Lunes 3 de mayo. Actuación musical de Olimpia en la plaza", ["Olimpia"])] == [["Olimpia"]]


VETOED = ["Gala de la Escuela de Baile Kanachined", "La verbena fue un éxito", "baile, juegos y talleres", "Se reunió la verbena", ""]
FILLER = "Nada más que decir aquí tampoco, de verdad que no hay nada, ni en esta línea ni en la que le sigue, que se sepa hoy, y así se dice\nNada\n"
HOURS = [
    ("Desde las 21:30, misa. De 23:00 a 05:00, gran verbena", "23:00"),
    ("21:30 misa\nLuego de 23:00 a 05:00 fuegos\n01:00 misa\nGran verbena popular", "23:00"),
    ("9:30 misa\nGran verbena popular", "09:30"),
    ("Gran verbena popular\n22:00 fuegos", "22:00"),
    (f"Gran verbena popular\n{FILLER}22:00 fuegos", ""),
    ("21:30 misa\n" + "Palabras y más palabras " * 20 + "\nGran verbena popular", ""),
]


def test_vetoes_and_hours_by_place(spark):
    texts = [*VETOED, *(t for t, _ in HOURS)]
    df = spark.createDataFrame([(i, f"Lunes 3 de mayo\n{t}") for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["hora"] for r in A.acts(df, "id", "t").collect()}
    assert got == {i + len(VETOED): hour for i, (_, hour) in enumerate(HOURS)}


def test_hours_carry_over_the_end_of_a_day(spark):
    near = acts(spark, "Lunes 3 de mayo\nmisa\n21:30 fuegos\nMartes 4\nGran verbena a continuación")
    far = acts(spark, "Lunes 3 de mayo\n21:30 fuegos\n" + "palabras y más " * 60 + "\nMartes 4\nGran verbena a continuación")
    assert [(a["day"], a["hora"]) for a in (*near, *far)] == [("", "21:30"), ("", "")]


def test_one_act_told_twice_is_one(spark):
    got = acts(spark, "Lunes 3 de mayo\n22:00 Gran verbena con la Orquesta Uno\n22:00 Gran verbena con la Orquesta Uno y Grupo Dos. Lugar: Casa Vieja\n23:00 Gran verbena")
    assert [(a["hora"], a["lugar"], a["orquestas"]) for a in got] == [("22:00", "Casa Vieja", ["Uno", "Dos"]), ("23:00", "Casa Vieja", [])]


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (P.venue_in, "Plaza Andrés de Lorenzo Cáceres Gran concierto del cantante", "Plaza Andrés de Lorenzo Cáceres"),
        (P.place_told, "Lugar: Casa de la Cultura. Entrada libre", "Casa de la Cultura"),
        (P.place_told, "Lugar: var x = {}", ""),
        (P.place_told, "nada", ""),
        (P.place_in_title, "Verbena en la Plaza del Charco con todos", "Plaza del Charco con todos"),
        (P.place_in_title, "Verbena en la plaza", ""),
        (lambda t: P.place_continued(t, F.lit("Gran verbena")), "Gran verbena con Uno\nPlaza Mayor\nfin", "Plaza Mayor"),
        (lambda t: P.place_continued(t, F.lit("Gran verbena")), "Gran verbena (en el Recinto Ferial)", "Recinto Ferial"),
        (lambda t: P.place_continued(t, F.lit("Gran verbena")), "Gran verbena\nmisa en la Plaza Mayor", ""),
    ],
)
def test_places(spark, column, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0] == want


def test_days_inherit_month_and_year(spark):
    text = "Viernes 11 de septiembre de 2026\n21.30h Gran verbena. Sábado 12\n22:00 Baile con Orquesta Olimpia. 13 Domingo misa"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Sábado 31 tardeo. 1 de agosto cena")], "id int, t string")
    got = A.acts(df, "id", "t").collect()
    assert [(r["id"], r["day"], r["hora"]) for r in sorted(got, key=lambda r: (r["id"], r["ord"]))] == [(1, "11-09-2026", "21:30"), (1, "12-09-2026", "22:00"), (3, "", "")]
    assert A.dated(df.limit(0), "id", "t").count() == 0
    plan = A.dated(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_texts_are_searched_and_sorted_once(spark):
    texts = ["Lunes 3 de mayo\n22:00 baile. Martes 4 gala", "Lunes 3 \x01uno\x02 Martes 4\x01", "nada", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in cut(df, ["id"], F.col("t"), R.HEADER).orderBy("id", "i").collect():
        got.setdefault(r["id"], []).append((r["hit"], r["piece"], r["pos"]))
    assert got == {0: [("", "", 0), ("Lunes 3 de mayo", "\n22:00 baile. ", 0), ("Martes 4", " gala", 29)], 1: [("", "", 0), ("Lunes 3", " \x01uno\x02 ", 0), ("Martes 4", "\x01", 14)], 2: [("", "nada", 0)], 3: [("", "", 0)], 4: [("", "", 0)]}
    plan = A.acts(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # as many tasks as there are partitions, whatever their bytes
    assert plan.count("Sort [") <= 6  # nine before: the rows of a text once by section and stretch
