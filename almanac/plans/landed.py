"""Queries of posters and landed pages over texts built of the driver's tables,
with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import posters
from almanac.plans.agenda import query
from almanac.session import read
from almanac.sources import pages as P


@query("WITH p AS (SELECT o_orderkey AS id, o_orderkey % 28 + 1 AS d, c_mktsegment AS s, DATE '2026-08-01' + CAST(o_orderkey % 28 AS INT) AS first FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT *, first + CAST((12 - isodow(first)) % 7 AS INT) AS second FROM p) SELECT id, 0 AS ord, strftime(first, '%d-%m-%Y') AS day, '21:30' AS hora, '21:30 Gran verbena con ' || s AS titulo, lower(s) AS nombres FROM q UNION ALL SELECT id, 1, strftime(second, '%d-%m-%Y'), '', 'Baile popular en la plaza', '' FROM q")
def poster_acts(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("PROGRAMA hasta el domingo 30\nSÁBADO "), (k % 28 + 1).cast("string"), F.lit(" de agosto\n• 21:30 Gran verbena con "), "c_mktsegment", F.lit("\nFuegos\nViernes\n· Baile popular en la plaza\n10:00 misa mayor"))
    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(k.alias("id"), text.alias("texto"), F.lit("2026-07-20").cast("date").alias("visto"))
    names = ["automobile", "building", "furniture", "household", "machinery"]
    return posters.poster_acts(rows, "id", "texto", "visto", names).withColumn("nombres", F.array_join("orquestas", ",")).drop("orquestas")


@query("SELECT page_id, u.i AS ord, CASE WHEN u.i = 2 THEN '05' ELSE '09' END AS mes, '2026' AS anyo, CASE WHEN u.i = 2 THEN 'Viernes 1' ELSE '3 & 4' END AS fecha, 'Lugar ' || page_id AS localidad, 'Verbena' AS tipo, 'Uno' AS orquestas FROM pages, (SELECT unnest([2, 4]) AS i) u")
def agenda_tables(spark, sf):
    row = lambda day: F.concat(F.lit(f"<tr><td>{day}</td><td>Lugar "), F.col("page_id").cast("string"), F.lit("</td><td>Verbena</td><td><b>Uno</b></td></tr>"))
    html = F.concat(F.lit("<h2>Mayo 2026</h2><table><tr><th>Fecha</th><th>L</th><th>T</th><th>O</th></tr>"), row("Viernes 1"), F.lit("</table><p>Septiembre de 2026</p><table>"), row("3 &amp; 4"), F.lit("<tr><td>x</td></tr></table>"))
    return P.agenda_tables(read(spark, sf, "pages").select("page_id", html.alias("html")), "page_id")


@query("SELECT 'post-' || page_id AS id, 'Gran baile & gala' AS texto, lower('User' || page_id) AS handle FROM pages WHERE page_id % 4 <> 0")
def public_posts(spark, sf):
    n = F.col("page_id").cast("string")
    description = F.when(F.col("page_id") % 4 != 0, '<meta name="description" content="Gran baile &amp; gala "/>').otherwise("")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x.com/photo?fbid="), n)).otherwise("https://x.com/p")
    html = F.concat(description, F.lit('<link rel="canonical" href="https://x.com/User'), n, F.lit("/posts/"), n, F.lit('">'))
    return P.public_posts(read(spark, sf, "pages").select(url.alias("url"), html.alias("html"))).select("id", "texto", "handle")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d-%m-%Y') AS day, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '21:30' END AS hora FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-02'")
def calendar_range(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.when(F.col("o_orderkey") % 3 == 0, day).otherwise(F.concat(day, F.lit("T21:30:00")))
    return P.upcoming(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start")), "1997-01-01").select("id", "day", "hora")


@query("SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05' AS hora, lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || '-04-2026,30-04-2026,01-05-2026' AS dias FROM orders")
def sheets(spark, sf):
    k = F.col("o_orderkey")
    h = (k % 24).cast("int")
    hour = F.concat(F.lit("abril 3 @ "), F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":05 "), F.when(h < 12, "am").otherwise("pm"))
    title = F.concat(F.lit("Baile: "), (k % 28 + 1).cast("string"), F.lit(", 30 de abril y 1 de mayo, 31 de junio"))
    return read(spark, sf, "orders").select(k.alias("id"), P.sheet_hour(hour).alias("hora"), F.array_join(P.title_days(title, F.lit(2026)), ",").alias("dias"))


@query("SELECT doc_id, u.i AS indice, u.i = 1 AS relevante FROM documents, (SELECT unnest([1, 2]) AS i) u WHERE doc_id % 3 <> 0")
def model_answers(spark, sf):
    good = '[1] Veamos [{"indice": 9}] y: ```[{"indice": 1, "relevante": true}, {"indice": 2, "relevante": false}]``` [fin'
    text = F.when(F.col("doc_id") % 3 == 0, 'no [{"otro": 1}]').otherwise(good)
    return P.answers(read(spark, sf, "documents").select("doc_id", text.alias("t")), "doc_id", "t", "indice int, relevante boolean")
