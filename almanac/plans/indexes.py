"""Queries of page indexes, places, alerts and accounts over rows built of the
driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import places as P
from almanac.operators import store as K
from almanac.plans.agenda import query
from almanac.plans.records import pick
from almanac.session import read
from almanac.sources import indexes as I

BASE = "https://b.es"
NOW = 2026
_LIST = lambda xs: "['" + "','".join(xs) + "']"
_TEXT = lambda c: c.cast("string")


# -------------------------------------------------------------------- indexes
@query("SELECT 'https://b.es/fiesta-' || (page_id % 50) AS url, 'Gran verbena del pueblo ' || min(page_id) AS titulo FROM pages GROUP BY 1 UNION ALL SELECT 'https://b.es/n' || page_id || '?a=1&b=2', 'Romería y baile de ' || page_id FROM pages")
def page_anchors(spark, sf):
    k = F.col("page_id")
    html = F.concat(
        F.lit("<ul><li><a href='/fiesta-"), _TEXT(k % 50), F.lit("'>Gran verbena\n del pueblo "), _TEXT(k), F.lit('</a><a href="https://b.es/x.pdf?v=1">Gran verbena en PDF</a>'),
        F.lit('<a href="//c.es/baile">Gran verbena de otro sitio</a><a class="z" href="https://b.es/n'), _TEXT(k), F.lit('?a=1&amp;b=2" id="i"><b>Romería</b> y baile de '), _TEXT(k),
        F.lit('</a><a href="/c">Gran baile</a><a href="/pleno">Pleno de la corporación</a><a name="x">Gran verbena sin enlace</a>'),
    )
    return I.anchors(read(spark, sf, "pages").select(k.alias("pag"), html.alias("html")), BASE, lambda t: T.fold(t).rlike("verbena|romeria"))


@query("SELECT 2000 + g // 12 AS anyo, g % 12 + 1 AS mes, 'https://b.es/' || (2000 + g // 12) || '/' || g || '/a' || pag || '.html' AS url, 'Programa de las fiestas ' || pag AS titulo FROM (SELECT page_id // 8 AS g, page_id % 8 + 1 AS pag FROM pages) WHERE pag <= CASE WHEN g % 3 = 0 THEN 3 WHEN g % 3 = 1 THEN 4 ELSE 6 END AND g IN (SELECT page_id // 8 FROM pages WHERE page_id % 8 = 0)")
def month_archives(spark, sf):
    """Archives of 8 pages: one whose page 4 repeats, one without page 5, one longer than is read."""
    rows = read(spark, sf, "pages").select(F.expr("page_id DIV 8").alias("g"), (F.col("page_id") % 8 + 1).alias("pag"))
    rows = rows.where("NOT (g % 3 = 1 AND pag = 5)").withColumn("anyo", F.expr("2000 + g DIV 12"))
    told = F.when((F.col("g") % 3 == 0) & (F.col("pag") == 4), 3).otherwise(F.col("pag"))
    url = F.concat(F.lit(f'<a href="{BASE}/'), _TEXT(F.col("anyo")), F.lit("/"), _TEXT(F.col("g")), F.lit("/a"), _TEXT(told), F.lit('.html">'))
    html = F.concat(url, F.lit("<img></a>"), url, F.lit("Programa de las fiestas "), _TEXT(told), F.lit(' 2026</a><a href="https://b.es/1999/z.html">Programa de otro año</a>'))
    return I.month_archives(rows.select("anyo", (F.col("g") % 12 + 1).alias("mes"), "pag", html.alias("html")), BASE)


@query("SELECT 'https://b.es/programacion/p' || page_id AS url, 'Gran verbena ' || page_id AS titulo, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'verbenas' END AS categoria, 'Sáb, ' || (page_id % 28 + 1) || '/09/26' AS dia, 'Lugar ' || page_id AS lugar, '/lugares/x/' || page_id AS lugar_url FROM pages UNION ALL SELECT 'https://b.es/programacion/siempre', 'Feria', '', '', '', '' FROM (SELECT 1 FROM pages LIMIT 1)")
def index_cards(spark, sf):
    n = _TEXT(F.col("page_id"))
    kind = F.when(F.col("page_id") % 3 == 0, "").otherwise('<span class="post-category"><a href="/categoria/v">Verbenas</a></span>')
    html = F.concat(
        F.lit('<div><div class="col small-post"><h4 class="title"><a href="/programacion/p'), n, F.lit('"> Gran \n verbena '), n, F.lit("</a></h4>"), kind,
        F.lit('<span class="post-date">Sáb, '), _TEXT(F.col("page_id") % 28 + 1), F.lit('/09/26</span><div class="post-category"><a href="/lugares/x/'), n, F.lit('">Lugar '), n,
        F.lit('</a></div></div><div class="small-post"><h4 class="title"><a href="/programacion/siempre">Feria</a></h4></div><div class="small-post"><h4 class="title"><a href="/otro">Fuera</a></h4></div></div>'),
    )
    return I.cards(read(spark, sf, "pages").select(F.col("page_id").alias("pag"), html.alias("html")), BASE)


@query("(SELECT doc_id AS id, 1 AS de FROM documents WHERE doc_id % 7 = 0 ORDER BY doc_id LIMIT 12) UNION ALL (SELECT doc_id, 2 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 ORDER BY doc_id LIMIT greatest(0, 12 - (SELECT count(*) FROM documents WHERE doc_id % 7 = 0)))")
def searches_in_order(spark, sf):
    docs = read(spark, sf, "documents")
    one = lambda n, de: docs.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"), F.lit(de).alias("de"))
    return I.in_order([one(7, 1), one(5, 2)], "id", "id", 12)


@query("SELECT page_id, CAST(CASE page_id % 6 WHEN 5 THEN 2026 ELSE 2020 + page_id % 10 END AS VARCHAR) AS anyo, CAST(CASE page_id % 3 WHEN 2 THEN 2026 ELSE 2020 + page_id % 10 END AS VARCHAR) AS ficha FROM pages")
def page_years(spark, sf):
    k = F.col("page_id")
    y = _TEXT(2020 + k % 10)
    url = F.when(k % 6 == 0, F.concat(F.lit("https://b.es/"), y, F.lit("/08/fiestas"))).otherwise("https://b.es/fiestas")
    html = (
        F.when(k % 6 == 0, '<time datetime="2019-01-01">').when(k % 6 == 1, F.concat(F.lit('<meta property="article:published_time" content="'), y, F.lit('-08-01">')))
        .when(k % 6 == 2, F.concat(F.lit("Fecha de publicación:\n<b>lunes</b> "), y)).when(k % 6 == 3, F.concat(F.lit("Posted 4 septiembre, "), y))
        .when(k % 6 == 4, F.concat(F.lit('<time datetime="'), y, F.lit('-02-03">'))).otherwise("<p>Sin fecha</p>")
    )
    chip = F.when(k % 3 == 0, F.concat(F.lit("Sáb, 12/09/"), F.substring(y, 3, 2))).otherwise("Sáb")
    text = F.when(k % 3 == 1, F.concat(F.lit("Verbena de "), y)).otherwise("Verbena")
    return read(spark, sf, "pages").select("page_id", I.year_of(url, html, F.lit(NOW)).alias("anyo"), I.chip_year(chip, text, F.lit(NOW)).alias("ficha"))


@query("SELECT 'Verbena' AS titulo, '18-09-2026' AS day, '23:30' AS hora, 'Uno' AS municipio, 'Plaza' AS lugar, 'a,b' AS nombres UNION ALL SELECT 'Baile', '19-09-2026', '', 'Dos', 'Parque', ''")
def literal_agenda(spark, sf):
    rows = [("Verbena", "18-09-2026", "23:30", "Uno", "Plaza", ["a", "b"], "u")] * 2 + [("Baile", "19-09-2026", "", "Dos", "Parque", [], "u")]
    return I.literal(spark, rows).withColumn("nombres", F.array_join("orquestas", ",")).drop("orquestas", "url")


# --------------------------------------------------------------------- places
VENUES = ["Plaza de la Pila", "Parque García Sanabria", "plaza de todos", "Cancha El Lomo hasta el muelle"]


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN {_LIST(VENUES)}[1] WHEN 1 THEN {_LIST(VENUES)}[2] ELSE 'Auditorio Municipal' END AS antes, CASE o_orderkey % 4 WHEN 0 THEN {_LIST(VENUES)}[1] WHEN 1 THEN {_LIST(VENUES)}[2] ELSE '' END AS despues, CASE WHEN o_orderkey % 4 < 2 THEN c_mktsegment ELSE '' END AS nucleo FROM orders JOIN customer ON o_custkey = c_custkey")
def venues(spark, sf):
    k = F.col("o_orderkey")
    v = pick(VENUES, k % 4)
    before = F.concat(F.lit("En el Auditorio Municipal, misa. En la "), v, F.lit(". Gran verbena de noche. Cierre"))
    after = F.concat(F.lit("Recinto Ferial. Gran verbena de noche, que será en: "), v, F.lit(", y fuegos"))
    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    title = F.lit("Gran verbena de noche")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    said = F.when(k % 4 < 2, F.concat(F.lit("barrio de "), F.lower("c_mktsegment"))).otherwise("barrio")
    return joined.select(k.alias("id"), P.place_before(before, title).alias("antes"), P.place_after(after, title).alias("despues"), P.known_in(said, names).alias("nucleo"))


@query("SELECT c_custkey AS id, 'Benijo ' || c_custkey AS barrio, CASE WHEN c_custkey % 5 <> 4 THEN n_name END AS municipio, CASE c_custkey % 2 WHEN 0 THEN replace(n_name, '_', ' ') ELSE lower(replace(n_name, '_', ' ')) || ' norte' END AS cuenta FROM customer JOIN nation ON c_nationkey = n_nationkey")
def headline_places(spark, sf):
    k = F.col("c_custkey")
    joined = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(k % 5 == 4, F.concat(F.lit("El Hierro, San Luis, "), "n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(", San Luis de France 2026")))
    title = F.concat(F.lit("Benijo "), _TEXT(k), F.lit(", "), own)
    names = [r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect()]
    name = F.when(k % 2 == 0, F.concat(F.lit("Ayuntamiento de "), "n_name")).otherwise("")
    url = F.concat(F.lit("https://x.com/"), F.lower("n_name"), F.lit(".norte/"))
    return joined.select(k.alias("id"), P.hamlet(title).alias("barrio"), P.municipality(title, names, ["El Hierro"]).alias("municipio"), P.account_place(url, name).alias("cuenta"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'El Médano' WHEN 1 THEN '' ELSE 'Medano' END AS nucleo, o_orderkey % 3 <> 1 AS dice, left(trim('Gran verbena ' || repeat('x', o_orderkey % 120)), 90) AS limpio, 'VIERNES ' || (o_orderkey % 28 + 1) || ' DE AGOSTO 21:30 SÁBADO DOMINGO 3 julio' AS arreglado FROM orders")
def mended_titles(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Fiestas en "), pick(["El Médano", "la costa", "Medano"], k % 3), F.lit(", verbena"))
    url = F.lit("https://b.es/programacion/fiestas-medano-granadilla-2026/")
    title = F.concat(F.lit("| Gran** \n verbena `"), F.repeat(F.lit("x"), (k % 120).cast("int")), F.lit(" ↓ "))
    programme = F.concat(F.lit("AGOSTO VIERNES "), _TEXT(k % 28 + 1), F.lit(" 21:30 H SÁBAD O D OMINGO 3 JUl"))
    return read(spark, sf, "orders").select(
        k.alias("id"), P.slug_core(text, url, F.lit("Granadilla"), ["fiestas"]).alias("nucleo"), T.says(text, F.lit("médano")).alias("dice"),
        T.clean_title(title).alias("limpio"), T.rewritten(programme, T.PROGRAMME).alias("arreglado"),
    )


# ------------------------------------------------------------ alerts, accounts
@query("WITH a AS (SELECT user_id, kind, max(event_id) AS newest, min(event_id) AS primero FROM (SELECT *, event_type AS kind FROM events) GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS municipio, kind AS tipo, 'u' AS url, newest AS \"at\", 'd' || newest AS detalle, primero FROM a ORDER BY primero DESC LIMIT 300")
def alert_ring(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(_TEXT(F.col("user_id")).alias("municipio"), F.col("event_type").alias("tipo"), F.lit("u").alias("url"), F.col("event_id").alias("at"), F.concat(F.lit("d"), _TEXT(F.col("event_id"))).alias("detalle"))
    stored = rows.where("at % 2 = 0").withColumn("primero", F.col("at"))
    return K.alerts(stored, rows.where("at % 2 = 1"))


@query("SELECT 'h' || s_suppkey AS handle, 'vieja' AS de, s_name AS nombre FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'h' || s_suppkey, 'nueva', s_name FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def imported_accounts(spark, sf):
    k = F.col("s_suppkey")
    handle = F.concat(F.lit("h"), _TEXT(k))
    s = read(spark, sf, "supplier")
    known = s.where(k % 2 == 0).select(handle.alias("id"), handle.alias("handle"), F.col("s_name").alias("nombre"), F.lit("").alias("url"), F.lit("otro").alias("tipo"), F.lit("").alias("municipio"), F.lit(True).alias("activa"), F.lit(0).cast("long").alias("createdAt"), F.lit(0).cast("long").alias("updatedAt"))
    url = F.when(k % 5 == 0, "https://x.com/friends/?a").otherwise(F.concat(F.lit("https://x.com/"), F.upper(handle), F.lit("/")))
    name = F.when(k % 3 == 0, "Editar perfil").otherwise(F.concat("s_name", F.lit(" ")))
    found = K.imported(known, s.select(name.alias("nombre"), url.alias("url"), F.lit("otro").alias("tipo"), F.lit("").alias("municipio")), "61/own", 9)
    return found.select("handle", F.when(F.col("createdAt") == 9, "nueva").otherwise("vieja").alias("de"), "nombre")
