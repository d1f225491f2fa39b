from __future__ import annotations

from almanac.functions import text as T
from almanac.operators import blocks as B
from almanac.operators import matching as M
from almanac.operators import resolve as R
from almanac.operators import store as K
from almanac.operators.parts import parts

COLUMNS = "id long, titulo string, day string, hora string, municipio string, lugar string, orquestas array<string>, fuente string, score int"


def event(i, titulo, lineup=(), lugar="", fuente="a", day="01-02-2026", hora="", score=4):
    return (i, titulo, day, hora, "Sur", lugar, list(lineup), fuente, score)


def test_fold_is_sequential_and_clusters_look_at_any_member(spark):
    rows = [event(1, "Gran noche alegre", ["x"]), event(2, "Otra cosa", ["y"]), event(3, "Tercera", ["x", "z"]), event(4, "Cuarta", ["z"], fuente="b"), event(5, "Gran noche alegre", ["x"], day="02-02-2026")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {(r["id"], r["grupo"]) for r in R.fold(df).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 5)}
    assert {(r["id"], r["grupo"]) for r in R.fold(df, any_member=True).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 5)}
    assert {tuple(r) for r in R.fuzzy_pairs(df).collect()} == {(1, 3), (3, 4)}
    assert R.fold(df.limit(0)).count() == 0


def test_folds_match_a_plain_scan(spark):
    import random

    rng = random.Random(3)
    words = [f"palabra{c}" for c in "abcdefgh"]
    rows = [event(i, " ".join(rng.sample(words, 3)), rng.sample("uvwxyz", rng.choice([0, 0, 1, 2])), rng.choice(["", "P", "Q"]), fuente=rng.choice("ab"), day=rng.choice(["01-02-2026", "02-02-2026"])) for i in range(160)]
    df = spark.createDataFrame(rows, COLUMNS)
    mine = [{"id": r[0], "day": r[2], "fuente": r[7], "lugar": r[5], "orq": set(r[6]), "toks": set(r[1].split())} for r in rows]
    pairs = {(a["id"], b["id"]) for a in mine for b in mine if a["id"] < b["id"] and a["day"] == b["day"] and R.alike(a, b)}
    assert {tuple(r) for r in R.fuzzy_pairs(df).collect()} == pairs and pairs
    for any_member in (False, True):
        groups, want = [], set()
        for r in sorted(mine, key=lambda r: (r["day"], r["fuente"], r["id"])):
            g = next((g for g in groups if g[0]["day"] == r["day"] and any(R.alike(m, r) for m in g)), None)
            if g is None:
                groups.append([dict(r, orq=set(r["orq"]))])
                g = groups[-1]
            elif any_member:
                g.append(r)
            else:
                g[0]["orq"] |= r["orq"]
            want.add((r["id"], g[0]["id"]))
        for whole in (50_000, 90, 0):  # no block split, one of two, both
            assert {(r["id"], r["grupo"]) for r in R.fold(df, any_member, whole).collect()} == want


def test_parts_are_connected_components(spark):
    import random

    rng = random.Random(5)
    links = [(i, h) for i in range(300) for h in rng.sample(range(400), rng.choice([0, 1, 1, 2]))] + [(1000 + i, 1000 + i + d) for i in range(70) for d in (0, 1)] + [(i, 7) for i in range(2000, 2200)] + [(None, 3), (5, None)]
    top = {i: i for i, _ in links if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    by: dict = {}
    for i, h in links:
        if i is not None and h is not None:
            by.setdefault(h, []).append(i)
    for ids in by.values():
        for i in ids[1:]:
            a, b = sorted((find(ids[0]), find(i)))
            top[b] = a
    got = {tuple(r) for r in parts(spark.createDataFrame(links, "id long, hub long")).collect()}
    assert got == {(i, find(i)) for i in top if find(i) != i}
    assert parts(spark.createDataFrame([], "id long, hub long")).count() == 0


def test_one_hot_block_is_dealt_by_its_parts(spark):
    rows = [event(i, "Gran noche", [f"n{i // 3}"], fuente="ab"[i % 2]) for i in range(300)] + [(900, None, "01-02-2026", "", "Sur", None, None, "a", 4)]
    df = spark.createDataFrame(rows, COLUMNS)
    split, plain = R.fold(df, whole=10), R.fold(df)
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in plain.collect()}
    assert split.select("grupo").distinct().count() == 101
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert sum(map(bool, R.fold(df, whole=10).rdd.glom().collect())) > 1  # one block, several tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_different_line_ups_at_one_place_are_not_merged(spark):
    df = spark.createDataFrame([event(1, "Verbena", ["Uno"], "Plaza"), event(2, "Verbena", ["Dos"], "Plaza"), event(3, "Verbena popular nocturna plaza", [], "Plaza"), event(4, "Verbena popular nocturna plaza", [], "Parque")], COLUMNS)
    assert {tuple(r) for r in R.fuzzy_pairs(df).collect()} == {(3, 4)}


def shuffled(spark, df):
    """The rows that a query shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def rows():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    df.write.format("noop").mode("overwrite").save()
    return rows() - before


def test_pairs_are_not_shuffled(spark):
    rows = [event(i, f"Gran noche alegre palabra{i % 3}", ["x"] if i % 2 else [], ["", "P", "Q", None][i % 4]) for i in range(400)]
    rows += [(900, None, "01-02-2026", "", "Sur", None, None, "a", 4), (901, "Gran noche alegre", "01-02-2026", "", "Sur", None, None, "a", 4)]
    df = spark.createDataFrame(rows, COLUMNS)
    mine = [{"id": r["id"], "lugar": r["lugar"] or "", "orq": set(r["orquestas"] or ()), "toks": set(r["t"] or ())} for r in df.withColumn("t", T.tokens(df.titulo)).collect()]
    pairs = sorted((a["id"], b["id"]) for a in mine for b in mine if a["id"] < b["id"] and R.alike(a, b))
    assert len(pairs) > 20_000
    for most, piece in ((512, 32_768), (7, 50)):
        assert sorted(tuple(r) for r in R.fuzzy_pairs(df, most, piece).collect()) == pairs
    assert shuffled(spark, R.fuzzy_pairs(df)) < 5_000


def test_candidates_that_say_the_same_are_matched_once(spark):
    kinds = "id long, day string, municipio string, orquestas array<string>, titulo string"
    events = [(i, "d1", ["Sur", "Norte", None][i % 3], [["x", "y"], ["y"], [], None][i % 4], ["Verbena alegre playa", "Verbena alegre", None][i % 3]) for i in range(300)] + [(3, "d1", "Sur", None, "Verbena alegre playa")]
    asked = [(1000 + i, ["d1", "d2", None][i % 7 % 3], ["", "Sur", "Norte", None][i % 4], [["x"], ["y", "x"], [], None][i % 5 % 4], ["Verbena alegre", "Playa verbena", None][i % 3]) for i in range(300)]
    words = lambda t: {w for w in (t or "").lower().split()}

    def meant(c, e):
        names = len(set(c[3] or ()) & set(e[3] or ()))
        return c[1] == e[1] and ((c[2] == "" and names > 0) or (bool(c[2]) and c[2] == e[2] and (names > 0 or len(words(c[4]) & words(e[4])) >= 2)))

    want = set()
    for c in asked:
        met = {e[0] for e in events if meant(c, e)}
        want.add((c[0], len(met), min(met) if len(met) == 1 else None, ["nuevo", "completa"][len(met)] if len(met) < 2 else "ambiguo"))
    found = M.candidate_matches(spark.createDataFrame(asked, kinds), spark.createDataFrame(events, kinds))
    assert {tuple(r) for r in found.collect()} == want and {w[3] for w in want} >= {"nuevo", "ambiguo"}
    assert shuffled(spark, found) < 5_000


def test_words_meet_places_without_a_sort(spark):
    texts = spark.createDataFrame([(1, "uno dos tres"), (2, "nada"), (3, None)], "k int, t string")
    places = spark.createDataFrame(spark.sparkContext.parallelize([("tres", "C"), ("dos", "B")]), "token string, lugar string")
    found = M.first_place(texts, "k", "t", places)
    assert {tuple(r) for r in found.collect()} == {(1, "B"), (2, None), (3, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [token" not in plan and "BroadcastHashJoin [token" in plan


def test_collapse_prefers_the_row_with_an_hour(spark):
    df = spark.createDataFrame([event(1, "Baile", ["A"]), event(2, "Baile grande", ["B"], hora="22:00", fuente="b", score=6)], COLUMNS)
    from pyspark.sql import functions as F

    r = R.collapse(df.withColumn("clave", F.lit("k"))).first()
    assert (r["id"], r["hora"], r["titulo"], r["orquestas"], r["fuentes"], r["score"], r["n"]) == (2, "22:00", "Baile grande", ["A", "B"], ["a", "b"], 6, 2)


def test_upsert_is_idempotent_and_replace_swaps(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "id long, v string")
    once = K.upsert(a, b)
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, None)]
    path = str(tmp_path / "t")
    K.replace(once, path)
    K.replace(K.upsert(spark.read.parquet(path), b), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "z"), (3, None)]
    part = K.upsert(a.withColumn("w", a.id), b)  # a batch without a stored column
    assert sorted(map(tuple, part.collect()), key=repr) == [(1, "x", 1), (2, "z", 2), (3, None, None)]
    (tmp_path / "t").rename(tmp_path / "t.new-1")  # as a swap that was cut off leaves it
    K.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    assert [r["id"] for r in K.gone(a, b).collect()] == [1] and [r["id"] for r in K.novel(b, a).collect()] == [3]


def varied(n):
    """Rows of one block that all say something else."""
    return [event(i, f"Gran noche palabra{'abcdefg'[i % 7]} otra{'hijklmnop'[i % 9]}", [f"n{i % 11}", f"m{i}"], f"P{i % 5}") for i in range(n)]


def test_rows_that_differ_are_shuffled_once(spark):
    assert shuffled(spark, R.fuzzy_pairs(spark.createDataFrame(varied(300), COLUMNS))) <= 300


def test_candidates_meet_events_where_these_lie(spark):
    e, c = spark.createDataFrame(varied(300), COLUMNS), spark.createDataFrame([(1000 + r[0], *r[1:]) for r in varied(60)], COLUMNS)
    whole = {tuple(r) for r in M.candidate_matches(c, e).collect()}
    assert len(whole) == 60 and {tuple(r) for r in M.candidate_matches(c, e, 7, 25).collect()} == whole
    assert shuffled(spark, M.candidate_matches(c, e)) <= 60 + 2 * 300


def test_marks_that_two_rows_share_are_counted(spark, monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    lists = [rng.sample(range(40), rng.choice([0, 1, 3])) + rng.sample(range(40, 44), 2) for _ in range(90)] + [[]]
    marks = B.Marks(pa.chunked_array([pa.array([[str(x) for x in v] for v in lists], pa.list_(pa.string()))]))
    for many in (512, 2, 5):
        monkeypatch.setattr(B, "MARKS", many)
        got = B.shared(marks, np.arange(20, 60), np.arange(0, 91))
        assert got.tolist() == [[len(set(a) & set(b)) for b in lists] for a in lists[20:60]]
