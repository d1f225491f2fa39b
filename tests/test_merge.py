"""The write path by two keys against a plain sequential reading; versions and leases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import leases as L
from almanac.operators import merge as M
from almanac.operators import versions as V

TODAY = "2026-01-10"


def fold(s):
    return s.lower().replace("í", "i")


def plain(stored, rows, source, at):
    """One row after the other, as dictionaries by id."""
    out = {k: dict(v) for k, v in stored.items()}
    by, went = {}, {}
    for k in sorted(out):
        by.setdefault(out[k]["clave"], []).append([k, out[k]["hora"]])
    for r in sorted(rows, key=lambda r: r["n"]):
        if (r["day"][6:], r["day"][3:5], r["day"][:2]) < ("2026", "01", "10"):
            continue
        to = went.get(r["id"]) or (r["id"] if r["id"] in stored else None)
        if to is None:
            group = by.setdefault(r["clave"], [])
            twin = next((e for e in group if r["hora"] and e[1] == r["hora"]), None)
            if twin is None and group and (not r["hora"] or not group[0][1] or group[0][1] == r["hora"]):
                twin = group[0]
                twin[1] = twin[1] or r["hora"]
            if twin is None:
                group.append([r["id"], r["hora"]])
                out[r["id"]] = {**{k: v for k, v in r.items() if k != "n"}, "fuente": source, "fuentes": [source], "estado": "activo", "at": at}
                went[r["id"]] = r["id"]
                continue
            to = twin[0]
        went[r["id"]] = to
        a = out[to]
        before = {k: v for k, v in a.items() if k != "at"}
        b = {**r, "fuentes": [source]}
        con, otra = (a, b) if a["hora"] or not b["hora"] else (b, a)
        names = list(con["orquestas"])
        names += [o for i, o in enumerate(otra["orquestas"]) if fold(o) not in {fold(x) for x in names + otra["orquestas"][:i]}]
        new = {
            "titulo": con["titulo"] if len(con["titulo"]) >= len(otra["titulo"]) else otra["titulo"], "day": con["day"], "hora": con["hora"], "municipio": con["municipio"], "lugar": con["lugar"] or otra["lugar"],
            "orquestas": names, "tipo": con["tipo"], "url": con["url"] or otra["url"], "score": max(a["score"], b["score"]), "motivos": list(dict.fromkeys(a["motivos"] + b["motivos"])), "fuentes": list(dict.fromkeys(con["fuentes"] + otra["fuentes"])),
        }
        a.update(new, fuente=new["fuentes"][0])
        if r["id"] == to:
            a["clave"] = r["clave"]
        if {k: v for k, v in a.items() if k != "at"} != before:
            a["at"] = at
    return out


def made(rng, n, ids):
    rows = []
    for i in range(n):
        clave = f"m|{rng.choice(['20-01-2026', '05-01-2026'])}|{rng.choice('abcdef')}"
        names = [rng.choice(x) for x in (["Uno", "uno"], ["Dos"], ["Línea", "linea"]) if rng.random() < 0.5]
        rows.append(dict(id=f"e{rng.randrange(ids):03d}", titulo="t" * rng.randrange(1, 6) + str(i % 7), day=clave[2:12], hora=rng.choice(["", "", "21:00", "22:00"]), municipio="m", lugar=rng.choice(["", "P", "Q"]), orquestas=names, tipo=rng.choice("xy"), url=rng.choice(["", "u", "v"]), score=rng.randrange(9), motivos=[rng.choice("pqr")], clave=clave, n=i))
    seen = {}  # rows of one id tell of one clave and hour, as a source's do
    for r in rows:
        first = seen.setdefault(r["id"], r)
        r.update({k: first[k] for k in ("clave", "day", "hora")})
    return rows


def frame(spark, rows):
    names = [c.split()[0] for c in M.BATCH.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], M.BATCH)


def table(spark, root):
    cut = lambda r: {c: r[c] for c in ("titulo", "day", "hora", "municipio", "lugar", "orquestas", "tipo", "url", "score", "motivos", "clave", "fuente", "fuentes", "estado")}
    return {r["id"]: {**cut(r), "at": r["actualizadoAt"]} for r in V.read(spark, root, M.STORED).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_sequential_reading(spark, tmp_path, seed):
    rng, root, want = random.Random(seed), str(tmp_path / "t"), {}
    for number in range(2):
        rows, source = made(rng, 60, 60), f"s{number % 2}"
        told = M.apply_batch(spark, root, frame(spark, rows), source, source, number, TODAY, 100 + number)
        before = {k: dict(v) for k, v in want.items()}
        want = plain(want, rows, source, 100 + number)
        for v in want.values():
            v.pop("id", None)
        got = table(spark, root)
        assert {k: {c: x for c, x in v.items() if c != "at"} for k, v in got.items()} == {k: {c: x for c, x in v.items() if c != "at"} for k, v in want.items()}
        assert told["nuevas"] == len(want.keys() - before.keys()) and told["escritas"] >= told["nuevas"] and told["leidas"] > 0
        for k, v in want.items():
            v["at"] = got[k]["at"]
        again = M.apply_batch(spark, root, frame(spark, made(rng, 5, 9)), source, source, number, TODAY, 999)
        assert again == {"leidas": 0, "escritas": 0, "nuevas": 0, "fusionadas": 0} and table(spark, root) == got
    assert len(want) >= 8 and any(v["day"] == "20-01-2026" for v in want.values()) and all(v["day"] != "05-01-2026" for v in want.values())


def test_a_batch_that_says_nothing_new_leaves_its_time(spark, tmp_path):
    root, rows = str(tmp_path / "t"), made(random.Random(4), 12, 40)
    M.apply_batch(spark, root, frame(spark, rows), "s", "s", 0, TODAY, 1)
    first = table(spark, root)
    told = M.apply_batch(spark, root, frame(spark, rows), "s", "s", 1, TODAY, 2)
    assert told["escritas"] == 0 and table(spark, root) == first and {v["at"] for v in first.values()} == {1}
    M.apply_batch(spark, root, frame(spark, []), "s", "s", 2, TODAY, 3)
    assert table(spark, root) == first


def test_a_stream_that_is_cut_off_goes_on(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path / "t")
    batches = [made(rng, 15, 30) for _ in range(3)]
    write = M.sink(root, "s", "st", TODAY, 7)
    for number, rows in enumerate(batches):
        write(frame(spark, rows), number)
        write(frame(spark, rows), number)  # the engine repeats what it is not sure of
    want = {}
    for rows in batches:
        want = plain(want, rows, "s", 7)
    assert {k: v["orquestas"] for k, v in table(spark, root).items()} == {k: v["orquestas"] for k, v in want.items()}
    assert V.latest(spark, root) == 3 and V.entry(spark, root, 3)["lotes"] == {"st": 2}


def test_versions_one_of_two_writers_wins(spark, tmp_path):
    root, kinds = str(tmp_path / "v"), "a int"
    assert V.latest(spark, root) == 0 and V.read(spark, root, kinds).count() == 0
    one = lambda x: spark.createDataFrame([(x,)], kinds)
    assert V.commit(one(1), root, 0) == 1
    with pytest.raises(V.Conflict):
        V.commit(one(2), root, 0)
    calls = []

    def change(df, log):
        calls.append(df.count())
        if len(calls) == 1:  # another writer comes between
            V.commit(df.union(one(5)), root, V.latest(spark, root))
        return df.union(one(9)), {"note": 1}

    assert V.update(spark, root, kinds, change) == 3 and calls == [1, 2]
    assert sorted(r["a"] for r in V.read(spark, root, kinds).collect()) == [1, 5, 9] and V.entry(spark, root, 3)["note"] == 1
    one(4).write.parquet(f"{root}/data/left-over")  # a writer that was cut off
    assert sorted(r["a"] for r in V.read(spark, root, kinds).collect()) == [1, 5, 9]
    V.clean(spark, root, keep=1)
    assert sorted(r["a"] for r in V.read(spark, root, kinds).collect()) == [1, 5, 9] and V.latest(spark, root) == 3
    assert len(list((tmp_path / "v" / "data").iterdir())) == 1


def test_leases_and_pauses(spark, tmp_path):
    root = str(tmp_path / "l")
    tasks = spark.createDataFrame([(k,) for k in ("a", "b", "c", None, "a")], "clave string")
    keys = lambda df: sorted(r["clave"] for r in df.collect())
    assert keys(L.take(spark, root, tasks, "x", 0, 2)) == ["a", "b"] and keys(L.take(spark, root, tasks, "y", 1, 9)) == ["c"]
    assert keys(L.take(spark, root, tasks, "z", 2, 9)) == []
    done = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "clave string, bien boolean")
    L.give_back(spark, root, done, "x", 10)
    rows = {r["clave"]: r for r in V.read(spark, root, L.LEASES).collect()}
    assert sorted(rows) == ["b", "c"] and (rows["b"]["fallos"], rows["b"]["proximo"]) == (1, 10 + 6 * L.HOUR) and rows["c"]["quien"] == "y"
    assert keys(L.take(spark, root, tasks, "z", 20, 9)) == ["a"]
    assert keys(L.take(spark, root, tasks, "w", 20 + 6 * L.HOUR, 9)) == ["a", "b", "c"]
    L.give_back(spark, root, done.where("clave = 'b'"), "w", 30 + 6 * L.HOUR)
    row = V.read(spark, root, L.LEASES).where("clave = 'b'").first()
    assert (row["fallos"], row["proximo"]) == (2, 30 + 6 * L.HOUR + 12 * L.HOUR)
    assert V.read(spark, root, L.LEASES).where(F.col("clave").isNull()).count() == 0
