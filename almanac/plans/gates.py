"""Queries of gates, layout mending and store changes over rows projected from
the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators import dictionary as N
from almanac.operators import gates as G
from almanac.operators import layout as L
from almanac.operators import matching as X
from almanac.operators import store as K
from almanac.plans.agenda import BILL, EV, NORM, SLUG, ev, evb, query
from almanac.plans.records import pick
from almanac.session import read

SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
_LIST = lambda xs: "['" + "','".join(xs) + "']"
PACES = ["", "caliente", "templada", "fria", "abandonada"]


# ---------------------------------------------------------------------- gates
@query(f"WITH a AS (SELECT *, s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 AS prio, {_LIST(PACES)}[s_suppkey % 5 + 1] AS ritmo FROM supplier) SELECT s_suppkey AS id, prio, prio OR ritmo <> 'abandonada' AS auto, (prio OR ritmo <> 'abandonada') AND ritmo IN ('', 'caliente') AS caliente, s_suppkey % 3 < 2 AND s_suppkey % 40 <= 7 AS fresca FROM a")
def account_gates(spark, sf):
    k = F.col("s_suppkey")
    handle = F.when(k % 11 == 0, " Primera").otherwise(F.concat(F.lit("h"), k.cast("string")))
    url = F.when(k % 13 == 0, "https://x.com/Segunda/posts").otherwise("https://x.com/otra")
    days = F.when(k % 3 < 2, k % 40)
    prio = G.is_priority(handle, url, ["primera", "segunda"])
    pace = pick(PACES, k % 5)
    return read(spark, sf, "supplier").select(k.alias("id"), prio.alias("prio"), G.is_read("auto", pace, prio).alias("auto"), G.is_read("caliente", pace, prio).alias("caliente"), G.is_fresh(days).alias("fresca"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28 18:00:00'")
def recent_alerts(spark, sf):
    return read(spark, sf, "events").where(G.is_recent(F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"))).select("event_id")


POSTS = ["Gran verbena", "x9 ~ |", "Nos vemos", "con building", "a las 22:30", "SÁBADO", "mayo", "2031"]


@query(f"SELECT o_orderkey AS id, o_orderkey % 8 NOT IN (1, 2) AS dice, o_orderkey % 5 <> 0 AND (o_orderkey % 6 = 1 OR (o_orderkey % 9 >= 4 AND (o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 8 = 0))) AS promovida, o_orderkey % 8 = 6 AS fuera FROM orders WHERE len({_LIST(POSTS)}) = 8")
def post_gates(spark, sf):
    k, text = F.col("o_orderkey"), pick(POSTS, F.col("o_orderkey") % 8)
    place = F.when(k % 5 != 0, "Lugar")
    names = F.when(k % 7 == 0, F.array(F.lit("Uno")))
    relevant = F.when(k % 6 == 0, False).when(k % 12 == 1, True)
    promoted = G.is_promoted(place, (k % 6 < 2), relevant, k % 9, k % 4 == 0, names, text)
    return read(spark, sf, "orders").select(k.alias("id"), G.says_something(text, SEGMENTS).alias("dice"), promoted.alias("promovida"), G.is_elsewhere(text, ["mayo", "otra isla"]).alias("fuera"))


@query("SELECT page_id, page_id % 4 = 0 AS cartel, page_id % 5 IN (0, 1, 2) AND page_id % 3 <> 0 AS entidad FROM pages")
def link_gates(spark, sf):
    k = F.col("page_id")
    src = F.concat(F.lit("https://x.org/2026/"), pick(["Cartel-fiesta.JPG?w=3", "logo.png", "programa.pdf", "verbena.jpg.html"], k % 4))
    url = F.concat(F.lit("https://m.x.com"), pick(["/alguien/", "/profile.php?id=12", "/pages/a/b", "/login?x", "/a/photos/3"], k % 5))
    name = F.when(k % 3 == 0, "A").otherwise("Ana")
    return read(spark, sf, "pages").select("page_id", G.is_poster(src, "2026").alias("cartel"), G.is_entity(url, name, "x.com", own="yo").alias("entidad"))


LISTED = ["Programa de actos", "Obras en la Villa", "Aviso", "Verbena", "Villano"]


@query("SELECT page_id, page_id % 5 IN (0, 1, 3) AS abrir FROM pages")
def opened_items(spark, sf):
    title = pick(LISTED, F.col("page_id") % 5)
    return read(spark, sf, "pages").select("page_id", G.is_opened(title, title == "Verbena", ["la villa"]).alias("abrir"))


_SET = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) > 3))"
_NAMED = "p_name || ' ' || p_type"


@query(f"WITH t AS (SELECT p_partkey, {_NAMED} AS a, CASE p_partkey % 3 WHEN 0 THEN upper({_NAMED}) || ' more and other words' WHEN 1 THEN p_brand ELSE p_type END AS b FROM part), s AS (SELECT p_partkey, {_SET.format('a')} AS x, {_SET.format('b')} AS y FROM t) SELECT p_partkey FROM s WHERE len(x) = 0 OR len(y) = 0 OR len(list_intersect(x, y)) < 0.8 * least(len(x), len(y))")
def covered_texts(spark, sf):
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type")
    p = read(spark, sf, "part")
    known = F.when(k % 3 == 0, F.concat(F.upper(name), F.lit(" more and other words"))).when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    return G.covered(p.select(k, name.alias("texto")), p.select(k, known.alias("texto")), key="p_partkey").select("p_partkey")


# --------------------------------------------------------------------- layout
@query("SELECT page_id, md5('Titulo ' || page_id || chr(10) || 'Cuerpo') AS cuerpo FROM pages")
def article_bodies(spark, sf):
    head = F.concat(F.lit('<h1 class="a post-title">Titulo '), F.col("page_id").cast("string"), F.lit("</h1><p>Cuerpo</p>"))
    html = F.concat(F.lit("<nav>Menu</nav>"), head, F.lit("<div class='share-post'>x</div>"), "html")
    return read(spark, sf, "pages").select("page_id", F.md5(L.article_body(html)).alias("cuerpo"))


@query("SELECT c_custkey AS id, u.parte, CASE WHEN c_custkey % 2 = 0 THEN '' WHEN u.parte = 0 THEN 'Plaza ' || c_mktsegment ELSE 'Casa Vieja' END AS lugar, CASE WHEN c_custkey % 2 = 0 THEN 'Gala. Baile.' WHEN u.parte = 0 THEN '• Plaza ' || c_mktsegment || '. Baile. ' ELSE '• Casa Vieja. Gala.' END AS texto FROM customer, (SELECT unnest([0, 1]) AS parte) u WHERE c_custkey % 2 = 1 OR u.parte = 0")
def venue_bullets(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, "Gala. Baile.").otherwise(F.concat(F.lit("Antes. • Plaza "), "c_mktsegment", F.lit(". Baile. • Casa Vieja. Gala.")))
    return L.by_place(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.alias("texto")))


READ_AS = ["SáBano", "DoMinco", "Sabana", "jueves", "viernez"]
MENDED = ["Sábado", "Domingo", "Sabana", "jueves", "viernes"]


@query(f"SELECT o_orderkey AS id, {_LIST(MENDED)}[o_orderkey % 5 + 1] || ' ' || (o_orderkey % 28 + 1) || ' gala en SáBano' AS texto FROM orders")
def mended_weekdays(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("id"), L.mended_weekdays(F.concat(pick(READ_AS, k % 5), F.lit(" "), (k % 28 + 1).cast("string"), F.lit(" gala en SáBano"))).alias("texto"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '21:00 - Baile (Plaza ' || c_mktsegment || ')' || chr(10) || 'fin' ELSE '21:00 h – Plaza' || chr(10) || 'Sábado 3' END AS texto FROM customer")
def hours_with_acts(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("21:00 h – Plaza "), "c_mktsegment", F.lit("\nBaile\nfin"))).otherwise("21:00 h – Plaza\nSábado 3")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), L.hour_with_act(text).alias("texto"))


@query("SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 10 + page_id % 90 WHEN 1 THEN 100 + page_id % 90 ELSE 0 END AS INT) AS pagina, CAST(CASE page_id % 5 WHEN 0 THEN 2021 WHEN 1 THEN 2022 WHEN 2 THEN 2023 WHEN 3 THEN 2024 ELSE 2026 END AS INT) AS anyo, CASE WHEN page_id % 31 + 1 >= 20 THEN '07' ELSE '08' END AS patronal, CAST([12, 2, 7, 9, -1][page_id % 5 + 1] AS INT) AS mes FROM pages")
def told_by_addresses(spark, sf):
    k = F.col("page_id")
    num = lambda c: c.cast("string")
    image = F.when(k % 3 == 0, F.concat(F.lit("/a/page-"), num(10 + k % 90), F.lit(".jpg"))).when(k % 3 == 1, F.concat(F.lit("/a/"), num(100 + k % 90), F.lit(".png"))).otherwise("/a/x.png")
    url = F.when(k % 5 == 0, "/2021/x").otherwise("/x")
    html = pick(["", '<meta property="article:published_time" content="2022-01-02">', '<time datetime="2023-04-05">', "<p>3 mayo, 2024</p>", "<p>hoy</p>"], k % 5)
    slug = pick(["fiesta-navidad-enero", "Carnaval", "el-carmen", "septiembre", "x"], k % 5)
    return read(spark, sf, "pages").select("page_id", L.page_number(image).alias("pagina"), L.year_of(url, html, 2026).alias("anyo"), L.month_by_day(k % 31 + 1, 20, "07", "08").alias("patronal"), L.month_in_slug(slug).cast("int").alias("mes"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || ',Otro' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN lower(c_mktsegment) ELSE '' END AS nombres FROM customer")
def rescued_names(spark, sf):
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("... "), s, F.lit(" y OTRO. Fin"))).when(k == 1, F.concat(s, F.lit(" y Plaza"))).when(k == 2, F.concat(s, F.lit(" y nada"))).otherwise("Nadie y Otro")
    texts = read(spark, sf, "customer").select("c_custkey", text.alias("t"))
    found = L.rescued(texts, "c_custkey", F.col("t"), N.of(spark, [x.lower() for x in SEGMENTS]))
    return texts.join(found, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("nombres", ","), F.lit("")).alias("nombres"))


_LINES = "li AS (SELECT l_orderkey AS id, l_linenumber AS ord, strftime(l_shipdate, '%d-%m-%Y') AS day, l_partkey % 3 AS n, l_suppkey % 2 AS has, l_returnflag AS f FROM lineitem)"


@query(f"WITH {_LINES}, a AS (SELECT * FROM li WHERE f <> 'N'), b AS (SELECT * FROM li WHERE n > 0 AND (id, ord) NOT IN (SELECT id, ord FROM a) QUALIFY row_number() OVER (PARTITION BY id, ord ORDER BY day, n) = 1) SELECT a.id, a.ord, CASE WHEN a.has = 0 AND b.id IS NOT NULL THEN b.day ELSE a.day END AS day, CASE WHEN a.has = 1 THEN 'Propia' WHEN b.id IS NOT NULL THEN 'N' || b.n ELSE '' END AS nombres FROM a LEFT JOIN b ON a.id = b.id AND b.ord = a.ord + 1")
def rescued_columns(spark, sf):
    li, own = read(spark, sf, "lineitem"), F.col("l_suppkey") % 2 == 1
    day, n = F.date_format("l_shipdate", "dd-MM-yyyy").alias("day"), F.col("l_partkey") % 3
    none = F.array().cast("array<string>")
    key = [F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), day]
    sections = li.select(*key, F.when(n > 0, F.array(F.concat(F.lit("N"), n.cast("string")))).otherwise(none).alias("nombres"))
    acts = li.where("l_returnflag <> 'N'").select(*key, F.when(own, F.array(F.lit("Propia"))).otherwise(none).alias("orquestas"))
    return L.across_columns(acts, sections).select("id", "ord", "day", F.array_join("orquestas", ",").alias("nombres"))


# ---------------------------------------------------------------------- store
_DUP = f"""{BILL}, s AS (SELECT *, id % 9 AS score, municipio || day AS g0, CASE WHEN id % 4 = 0 THEN 'viejo' END AS estado FROM evb), g AS (SELECT *, min(id) OVER (PARTITION BY municipio, day) AS grupo FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY grupo ORDER BY hora = '', -len(orquestas), -length(titulo), id) AS r, row_number() OVER (PARTITION BY grupo ORDER BY -length(titulo), id) AS t FROM g),
 u AS (SELECT grupo, max(score) AS score, string_agg(DISTINCT fuente, ',' ORDER BY fuente) AS fuentes FROM r GROUP BY 1),
 o AS (SELECT grupo, string_agg(DISTINCT x, ',' ORDER BY x) AS nombres FROM (SELECT grupo, unnest(orquestas) AS x FROM r) GROUP BY 1)"""


@query(f"WITH {_DUP}, m AS (SELECT k.id, k.hora, k.day, t.titulo, coalesce(o.nombres, '') AS nombres, u.fuentes, CAST(u.score AS BIGINT) AS score, k.municipio, coalesce((SELECT estado FROM r WHERE r.grupo = u.grupo AND r.r = 1), 'activo') AS estado FROM u JOIN r k ON k.grupo = u.grupo AND k.r = 1 JOIN r t ON t.grupo = u.grupo AND t.t = 1 LEFT JOIN o ON o.grupo = u.grupo) SELECT id, hora, titulo, nombres, fuentes, score, estado, {NORM.format('municipio')} || '|' || day || '|' || CASE WHEN nombres <> '' THEN string_split(nombres, ',')[1] ELSE {SLUG.replace('{0}', 'titulo')} END AS clave FROM m")
def store_deduplicated(spark, sf):
    e = evb(spark, sf)
    none = F.lit(None)
    stored = e.withColumns({"score": F.col("id") % 9, "estado": F.when(F.col("id") % 4 == 0, "viejo"), "clave": none.cast("string"), "fuentes": none.cast("array<string>")})
    groups = e.select("id", F.min("id").over(Window.partitionBy("municipio", "day")).alias("grupo"))
    return K.deduplicated(stored, groups).select("id", "hora", "titulo", F.array_join("orquestas", ",").alias("nombres"), F.array_join("fuentes", ",").alias("fuentes"), "score", "estado", "clave")


@query("WITH s AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1) SELECT DISTINCT e.user_id AS id, CASE WHEN last = 'signup' THEN 'activo' ELSE 'viejo' END AS estado, coalesce(last = 'error', false) AS cancelable FROM events e LEFT JOIN s ON e.user_id = s.id")
def lifecycle(spark, sf):
    e = read(spark, sf, "events")
    stored = e.select(F.col("user_id").alias("id")).distinct().select("id", F.lit("viejo").alias("estado"), F.lit(False).alias("posibleCancelacion"))
    kind = F.col("event_type")
    signals = e.where(kind.isin("error", "signup")).select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (kind == "error").alias("cancela"), (kind == "signup").alias("retoma"))
    return K.with_states(stored, signals).select("id", "estado", F.col("posibleCancelacion").alias("cancelable"))


@query("SELECT sha1(url) AS clave, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS at, CASE WHEN page_id % 2 = 0 THEN 'nuevo' ELSE 'viejo' END AS texto FROM (SELECT url, max(page_id % 2) AS odd, min(page_id % 2) AS page_id FROM pages GROUP BY url)")
def text_cache(spark, sf):
    p = read(spark, sf, "pages")
    fresh = p.where("page_id % 2 = 0").select("url", F.lit(2).alias("at"), F.lit("nuevo").alias("texto"))
    return K.cached(p.select("url", F.lit(1).alias("at"), F.lit("viejo").alias("texto")), fresh).select("clave", "at", "texto")


@query("SELECT c_custkey AS id FROM customer QUALIFY c_custkey > min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment)")
def handle_conflicts(spark, sf):
    accounts = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("handle"))
    return K.conflicts(accounts).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey % 3 > 0 THEN '/m/' || c_name END AS imagen FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def featured_media(spark, sf):
    posts = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("featured_media"))
    media = read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/m/"), "c_name").alias("source_url"))
    return K.with_media(posts, media).select("id", "imagen")


@query(f"WITH {EV}, q AS (SELECT id, id % 9 AS score, id % 40 AS dias, lugar <> '' AS cartel FROM ev) SELECT id, cartel, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY cartel DESC, score DESC, id) AS puesto FROM q QUALIFY puesto <= 120")
def verdict_queue(spark, sf):
    """The 120 candidates (a limit of the queue itself) to be judged first."""
    q = ev(spark, sf).select("id", (F.col("lugar") != "").alias("cartel"), (F.col("id") % 9).cast("long").alias("score"))
    top = q.orderBy(F.desc("cartel"), F.desc("score"), "id").limit(120)
    return top.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("cartel"), F.desc("score"), "id")).cast("long"))


@query(f"WITH {EV} SELECT id, row_number() OVER (PARTITION BY fuente, municipio ORDER BY id % 9 DESC, id % 40, id) AS puesto FROM ev")
def candidate_order(spark, sf):
    rows = ev(spark, sf).select("id", "fuente", "municipio", (F.col("id") % 9).alias("score"), (F.col("id") % 40).alias("dias"))
    return X.ranked(rows, "fuente", "municipio").select("id", "puesto")


@query(f"WITH {EV} SELECT municipio, count(*) AS leidas, count(*) FILTER (lugar <> '') AS escritas, count(*) FILTER (hora = '') AS ambiguas FROM ev GROUP BY 1")
def run_counters(spark, sf) -> DataFrame:
    return ev(spark, sf).groupBy("municipio").agg(F.count("*").alias("leidas"), F.count_if(F.col("lugar") != "").alias("escritas"), F.count_if(F.col("hora") == "").alias("ambiguas"))
