"""Pages of several sources by one plan and a table of knobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from almanac.operators import template as A
from almanac.plans import adapters as P


def told(rows):
    return sorted((r["fuente"], r["titulo"], r["day"], r["hora"], r["lugar"], ",".join(r["orquestas"]), r["tipo"], r["score"]) for r in rows)


def test_eight_shapes_from_landed_files(spark, tmp_path):
    for i, (_, url, html, _) in enumerate(P.SHAPES):
        folder = tmp_path / f"fuente=f{i}"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps({"url": f"https://s.es/{url}", "html": html}) + "\n" + json.dumps({"url": "https://s.es/2026/nada", "html": None}))
    base = str(tmp_path)
    want = sorted((f"f{i}", *r) for i, (*_, rows) in enumerate(P.SHAPES) for r in rows)
    found = A.events(A.landed(spark, base), P.table(spark))
    rows = found.collect()
    assert told(rows) == want and found.columns == A.EVENT
    assert len({r["id"] for r in rows}) == len(rows) and all(r["municipio"] for r in rows)
    assert [r["motivos"][-1] for r in rows if r["fuente"] == "f0"] == ["noticia"] * 2
    two = A.landed(spark, base, ["f2", "f5"])
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [fuente" in plan and {r[0].split("fuente=")[1][:2] for r in two.select(F.input_file_name()).collect()} == {"f2", "f5"}
    assert told(A.events(two, P.table(spark)).collect()) == [w for w in want if w[0] in ("f2", "f5")]


def test_pages_that_give_nothing(spark):
    kinds = "fuente string, url string, html string"
    rows = [("f0", None, None), ("f0", "https://s.es/2026/a", ""), ("other", "https://s.es/2026/a", P.SHAPES[0][2]), (None, "https://s.es/2026/a", "x"), ("f0", "https://s.es/2019/a", P.SHAPES[0][2])]
    pages = spark.createDataFrame(rows, kinds)
    assert A.events(pages, P.table(spark)).count() == 0 and A.events(pages.limit(0), P.table(spark)).count() == 0
    twice = spark.createDataFrame([("f0", "https://s.es/2026/a", P.SHAPES[0][2])] * 2, kinds)
    assert A.events(twice, P.table(spark)).count() == len(P.SHAPES[0][3])


def test_html_is_cleaned_once(spark):
    pages = spark.createDataFrame([("f0", "https://s.es/2026/a", P.SHAPES[0][2])], "fuente string, url string, html string")
    plan = A.events(pages, P.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "published_time" not in plan and "html" not in plan
