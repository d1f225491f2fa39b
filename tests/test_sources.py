from __future__ import annotations

import json

from pyspark.sql import functions as F

from almanac.sources import landing as L
from almanac.sources import pdf


def test_json_landings(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"cuenta": "c", "url": "u", "revisadoEl": "2026-09-13", "posts": [{"texto": "hola", "fecha": "ayer"}, {"texto": ""}]}))
    (tmp_path / "p/b.json").write_text("{not json")
    assert [(r["cuenta"], r["texto"], r["dias"]) for r in L.posts(spark, str(tmp_path / "p")).collect()] == [("c", "hola", 1)]
    (tmp_path / "w.json").write_text(json.dumps([{"date": "2026-05-01T10:00:00", "link": "l", "title": {"rendered": "A &amp; B"}, "content": {"rendered": "<p>x</p><p>y</p>"}}, {"date": "2025-01-01T00:00:00"}]))
    assert [(r["titulo"], r["texto"]) for r in L.cms_posts(spark, str(tmp_path / "w.json"), 2026).collect()] == [("A & B", "x\ny")]
    (tmp_path / "c.json").write_text(json.dumps({"events": [{"id": "1", "title": "Gala", "start_date": "2026-09-20 21:30:00"}, {"id": "2", "title": "Otra", "start_date": "2027-01-01 00:00:00"}]}))
    got = L.calendar(spark, str(tmp_path / "c.json"), "2026-09-13", "2026-12-12")
    assert [(r["id"], r["day"], r["hora"], r["lugar"]) for r in got.collect()] == [("1", "20-09-2026", "21:30", "")]
    (tmp_path / "s.xml").write_text("<urlset><loc>https://x.es/fiestas-de-mayo/</loc><loc> https://x.es/a-b </loc></urlset>")
    assert sorted(r["titulo"] for r in L.sitemap(spark, str(tmp_path / "s.xml")).collect()) == ["A B", "Fiestas De Mayo"]
    specs = [L.SourceSpec("uno", str(tmp_path / "s.xml"), L.sitemap), L.SourceSpec("dos", "/nowhere", L.sitemap, 1)]
    failed = {}
    assert L.union(spark, specs, failed=failed).select("fuente").distinct().collect()[0][0] == "uno" and list(failed) == ["dos"]
    assert L.union(spark, specs, only="UNO").select("fuente").distinct().collect()[0][0] == "uno"


def test_ocr_and_links(spark):
    docs = spark.createDataFrame([("u1",), ("u2",)], "url string")
    texts = spark.createDataFrame([("u1", 0, 1, False, "x" * 300), ("u2", 0, 1, False, "short")], L.OCR)
    assert {(r["url"], r["ocr"] is not None) for r in L.with_ocr(docs, texts).collect()} == {("u1", True), ("u2", False)}
    pages = spark.createDataFrame([("u", '<a href="/programa-2026.pdf">a</a><a href="/programa-2025.pdf">b</a><a href="/x.html">c</a>')], "url string, html string")
    assert [r["href"] for r in L.program_links(pages, 2026).collect()] == ["/programa-2026.pdf"]


def test_pages_in_columns_and_repairs(spark):
    left, right = [(f"l{i}", 50.0, 700.0 - 20 * i) for i in range(4)], [(f"r{i}", 350.0, 700.0 - 20 * i) for i in range(4)]
    df = spark.createDataFrame([("u", 1, 600.0, s, x, y, 100.0) for s, x, y in left + right], "url string, page int, width double, s string, x double, y double, w double")
    assert pdf.page_texts(df).first()["texto"].split("\n") == ["l0", "l1", "l2", "l3", "r0", "r1", "r2", "r3"]
    wide = df.union(spark.createDataFrame([("u", 1, 600.0, "heading", 40.0, 740.0, 500.0)], df.schema))
    assert pdf.page_texts(wide).first()["texto"].split("\n") == ["heading", "l0", "l1", "l2", "l3", "r0", "r1", "r2", "r3"]
    assert pdf.page_texts(df, columns=False).first()["texto"].split("\n")[0] == "l0 r0"
    cases = {"BOM - BA": "BOMBA", "veci - nas": "vecinas", "Música - Baile": "Música - Baile", "8 de septiembe": "8 de septiembre"}
    for text, want in cases.items():
        assert spark.range(1).select(pdf.repaired(F.lit(text))).first()[0] == want
