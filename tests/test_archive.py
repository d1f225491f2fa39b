from __future__ import annotations

import json

from almanac.sources import archive as A


def test_shapes_types_and_what_does_not_fit(spark, tmp_path):
    good = {"titulo": "Baile", "day": "2024-08-03", "municipio": "Sur", "orquestas": ["A", "B"], "score": 7}
    files = {
        "array.json": [good, {**good, "day": "2024-08-04", "score": "5", "nuevo": {"x": [1]}}, 7, {"titulo": "sin"}, {**good, "day": "ayer"}, {**good, "orquestas": "A"}, {**good, "municipio": None}],
        "events.json": {"version": 2, "events": [{"title": "Verbena", "fecha": "2025-01-02", "municipio": " Norte "}]},
        "by_id.json": {"k1": good, "k2": {**good, "score": "muchos"}},
        "empty.json": [], "number.json": 3, "null.json": None,
    }
    for name, held in files.items():
        (tmp_path / name).write_text(json.dumps(held))
    (tmp_path / "broken.json").write_text('[{"titulo": "x"')
    texts = A.files(spark, str(tmp_path))
    got = {(r["id"], r["titulo"], str(r["day"]), r["municipio"], tuple(r["orquestas"] or ()), r["score"]) for r in A.events(texts).collect()}
    assert got == {
        ("array.json#0", "Baile", "2024-08-03", "Sur", ("A", "B"), 7), ("array.json#1", "Baile", "2024-08-04", "Sur", ("A", "B"), 5),
        ("events.json#0", "Verbena", "2025-01-02", " Norte ", (), None), ("k1", "Baile", "2024-08-03", "Sur", ("A", "B"), 7),
    }
    assert {tuple(r) for r in A.aside(texts).collect()} == {
        ("array.json", "no object", 1), ("array.json", "no day", 1), ("array.json", "bad day", 1), ("array.json", "bad orquestas", 1), ("array.json", "no municipio", 1),
        ("by_id.json", "bad score", 1), ("number.json", "no json", 1), ("null.json", "no json", 1), ("broken.json", "no json", 1),
    }
    kept = A.events(texts).where("id = 'array.json#1'").selectExpr("variant_get(item, '$.nuevo.x[0]', 'int') AS x").first()
    assert kept["x"] == 1
    out = str(tmp_path / "out")
    A.events(texts).write.parquet(out)  # items stay VARIANT when they are written
    assert spark.read.parquet(out).selectExpr("count(variant_get(item, '$.municipio', 'string')) AS n").first()["n"] == 4
    hot = {(r["municipio"], r["total"], r["mes"], r["n"], r["caliente"]) for r in A.calendar(A.events(texts)).collect()}
    assert hot == {("Sur", 3, "08", 3, True), ("Norte", 1, "01", 1, False)}
