from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import order as O


def test_names_in_spanish_order(spark):
    names = ["nz", "ñu", "Ñandú", "oso", "Ángel", "angel", "b", None, "ñandu", "", "ángel"]
    df = spark.createDataFrame([(n,) for n in names], "nombre string")
    assert [r["nombre"] for r in O.sorted_by_name(df, "nombre").collect()] == [None, "", "angel", "ángel", "Ángel", "b", "nz", "ñandu", "Ñandú", "ñu", "oso"]
    assert O.sorted_by_name(df.limit(0), "nombre").count() == 0


def test_names_meet_regardless_of_case_and_marks(spark):
    left = spark.createDataFrame([(1, "ÁNGEL "), (2, "cana"), (3, "caña"), (4, None)], "_name long, nombre string")
    right = spark.createDataFrame([("angel", "a"), (unicodedata.normalize("NFD", "Caña"), "b"), (None, "c")], "nombre string, v string")
    got = {tuple(r) for r in O.joined_by_name(left, right, "nombre").select("_name", "nombre", "v").collect()}
    assert got == {(1, "ÁNGEL ", "a"), (3, "caña", "b")}
    assert O.joined_by_name(left, right, "nombre", how="left").count() == 4
    many = spark.createDataFrame([(n,) for n in ["Pérez", "perez", "PEREZ", "perez ", "ñ", "n", None, "Éa", "ea"]], "nombre string")
    assert {tuple(r) for r in O.one_spelling(many, "nombre").collect()} == {("perez", 4), ("ñ", 1), ("n", 1), ("ea", 2)}


def test_folding_of_composed_and_decomposed_letters(spark):
    text = "Ángel Ñandú ČEŠTINA ő Ż ấ"
    df = spark.createDataFrame([(text, unicodedata.normalize("NFD", text)), (None, None)], "a string, b string")
    r = df.select(T.words_only(F.col("a")), T.words_only(F.col("b")), T.compact(F.col("b")), F.char_length(T.fold(F.col("b"))) == F.char_length("b"), T.fold(F.col("a"))).collect()
    assert tuple(r[0]) == ("angel nandu cestina o z a", "angel nandu cestina o z a", "angelnanducestinaoza", True, "angel nandu cestina o z a")
    assert r[1][0] is None
    drawn = spark.createDataFrame([("𝗩𝗘𝗥𝗕𝗘𝗡𝗔 ﬁn Ⓐ ２２ é",), (None,), ("",)], "t string")
    assert [r[0] for r in drawn.select(T.spelled_plain("t")).collect()] == ["VERBENA fin A 22 e", None, ""]


def test_words_of_a_text_are_not_dealt_one_by_one(spark, tmp_path):
    from test_resolve import shuffled

    from almanac.plans import history

    texts = [(i, " ".join(f"palabra{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10]} Ñu" for j in range(100))) for i in range(40)] + [(3, "otra ñu"), (50, "1 2"), (51, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = history.words_in_order(spark, str(tmp_path))
    assert {r["doc_id"]: r["n"] for r in found.collect()} == {i: 101 for i in range(40)} | {3: 103}
    assert shuffled(spark, found) < 100
