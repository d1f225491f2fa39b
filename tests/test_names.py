"""Names of a dictionary in texts, and words with one spelling error."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import dictionary as N
from almanac.operators import layout as L
from almanac.operators import spelling as S

TEXT = "k int, t string"


def plain_hits(texts, names):
    fold = lambda s: "".join(c if c.isalnum() else " " for c in s.lower()).split()
    out = []
    for k, t in texts:
        words = fold(t or "")
        for r, n in names:
            w = fold(n)
            out += [(k, r, n, i) for i in range(len(words) - len(w) + 1) if w and words[i : i + len(w)] == w]
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 3])
def test_hits_equal_a_plain_search(spark, most):
    rng = random.Random(4)
    word = lambda: rng.choice("a b c ab bc abc la los".split())
    names = [(i, n) for i, n in enumerate(sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(60)}))] + [(90, "A"), (91, ""), (92, "--")]
    texts = [(i, " ".join(rng.choice(["", ",", "\n"]) + word() for _ in range(rng.randrange(30)))) for i in range(80)] + [(500, None), (501, "")]
    df, known = spark.createDataFrame(texts, TEXT), spark.createDataFrame(names, "rango int, nombre string")
    got = sorted(tuple(r) for r in N.hits(df, "k", F.col("t"), known, most).collect())
    assert got == plain_hits(texts, names) and len(got) > 500
    first = {r["k"]: r["nombre"] for r in N.first_hit(df, "k", F.col("t"), known).collect()}
    assert first == {k: min(((r, n) for kk, r, n, _ in got if kk == k), default=(0, None))[1] for k, _ in texts}
    assert N.hits(df.limit(0), "k", F.col("t"), known, most).count() == 0 and N.hits(df, "k", F.col("t"), known.limit(0), most).count() == 0


def test_a_hundred_thousand_names(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 7)))
    names = [(i, f"{word()} {word()}") for i in range(100_000)]
    texts = [(i, " ".join(f"{word()} {names[rng.randrange(100_000)][1]}" for _ in range(20))) for i in range(50)]
    df, known = spark.createDataFrame(texts, TEXT), spark.createDataFrame(names, "rango int, nombre string")
    a, b = (sorted(tuple(r) for r in N.hits(df, "k", F.col("t"), known, most).collect()) for most in (100_000, 10))
    assert a == b and len(a) >= 1000


def test_names_of_a_poster(spark):
    rows = [(0, "...WAMAMPY y REVELACIÓN"), (1, "WAMAMPY y Verbena"), (2, "y Nadie"), (3, ""), (4, None), (5, "Los Ideales y wamampy, y Línea"), (6, "wamampy y otra"), (7, "dl y Dl y Uno"), (8, "Ideales y Los Ideales y DOS")]
    df = spark.createDataFrame(rows, TEXT)
    got = {r["k"]: r["nombres"] for r in L.rescued(df, "k", F.col("t"), N.of(spark, ["wamampy", "dl", "los ideales", "ideales"])).collect()}
    assert got == {0: ["wamampy", "Revelación"], 1: ["wamampy"], 5: ["wamampy", "los ideales", "Línea"], 6: ["wamampy"], 7: ["dl"], 8: ["los ideales", "Dos"]}


def test_one_error_is_found_without_comparing_all(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words, names = sorted({word(rng.randrange(1, 7)) for _ in range(150)}), sorted({word(rng.randrange(1, 7)) for _ in range(150)})

    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    left, right = spark.createDataFrame([(w,) for w in [*words, None]], "palabra string"), spark.createDataFrame([(n,) for n in names], "nombre string")
    met = S.near(left, right)
    got = {(r["palabra"], r["nombre"]): r["distancia"] for r in met.collect()}
    assert set(got) == {(w, n) for w in words for n in names if within(w, n)} and all((d == 0) == (w == n) for (w, n), d in got.items())
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nearest = {r["palabra"]: r["nombre"] for r in S.nearest(left, right).collect()}
    assert nearest == {w: min((d, n) for (v, n), d in got.items() if v == w)[1] for w in {w for w, _ in got}}
    assert S.near(left.limit(0), right).count() == 0
