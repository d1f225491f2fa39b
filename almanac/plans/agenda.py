"""The queries of the library over the driver's tables, and their DuckDB SQL.

Event rows are projected from orders, customer, nation, lineitem and part, as
the tables hold no programme texts; lexicons are injected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import lifecycle as C
from almanac.operators import resolve as R
from almanac.operators import store as K
from almanac.operators.scoring import Rule, scored
from almanac.session import read
from almanac.streaming import events as S

TODAY = "1998-01-01"
#: Lexicons of the test domain.
NAMES = ["automobile", "building", "furniture", "household", "machinery"]
SEGMENTS = ["BUILDING", "MACHINERY"]

_SQL: dict[str, str] = {}
_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

EV = """ev AS (
 SELECT o_orderkey AS id, concat_ws(' ', o_orderpriority, c_mktsegment, c_name) AS titulo, CAST(o_orderdate AS DATE) AS fecha,
  strftime(o_orderdate, '%d-%m-%Y') AS day, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS hora,
  n_name AS municipio, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Plaza ' || c_mktsegment END AS lugar, o_orderstatus AS fuente
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
BILL = f"""{EV}, bill AS (
 SELECT l_orderkey AS id, list_sort(list_distinct(list(p_brand))) AS orquestas FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
evb AS (SELECT ev.*, coalesce(orquestas, CAST([] AS VARCHAR[])) AS orquestas FROM ev LEFT JOIN bill USING (id))"""
NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z]+', ' ', 'g'))"
STOP = "['" + "','".join(T.STOP) + "']"
TOKS = "list_distinct(list_filter(string_split(" + NORM + f", ' '), lambda t: len(t) > 3 AND NOT list_contains({STOP}, t)))"
SLUG = "array_to_string(list_filter(string_split(" + NORM + f", ' '), lambda t: len(t) > 2 AND NOT list_contains({STOP}, t))[1:5], '-')"


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _RUN[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("id"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "c_name").alias("titulo"), F.to_date("o_orderdate").alias("fecha"), D.day_text(F.col("o_orderdate")).alias("day"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":00"))).alias("hora"), F.col("n_name").alias("municipio"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Plaza "), "c_mktsegment")).alias("lugar"), F.col("o_orderstatus").alias("fuente"),
    )


def evb(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows with their line-up, in order of name."""
    bill = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("orquestas"))
    return ev(spark, sf).join(bill, "id", "left").withColumn("orquestas", F.coalesce("orquestas", F.array().cast("array<string>")))


# ------------------------------------------------------------- agenda, filters
AGENDA = "id, titulo, day, hora, municipio, lugar, fuente"


def agenda(spark: SparkSession, sf: str, which: str = "futuras", fuente: str | None = None, today: str = TODAY) -> DataFrame:
    """The agenda in order of date and hour, what lacks either last."""
    e = ev(spark, sf)
    if fuente:
        e = e.where(F.lower("fuente") == fuente.lower())
    future = D.is_future(F.col("day"), today)
    e = e if which == "todas" else e.where(~future if which == "pasadas" else future)
    return e.orderBy(D.as_date(F.col("day")).asc_nulls_last(), F.nullif("hora", F.lit("")).asc_nulls_last(), "id").select(*AGENDA.split(", "))


for _name, _which, _cond in (("future", "futuras", f"fecha >= DATE '{TODAY}'"), ("past", "pasadas", f"fecha < DATE '{TODAY}'"), ("all", "todas", "true")):
    query(f"WITH {EV} SELECT {AGENDA} FROM ev WHERE {_cond}", f"agenda_{_name}")(partial(agenda, which=_which))
query(f"WITH {EV} SELECT {AGENDA} FROM ev WHERE fuente = 'F' AND fecha >= DATE '{TODAY}'", "agenda_by_source_pruned")(partial(agenda, fuente="F"))


@query("SELECT o_orderkey AS id, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS day_num, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def day_num_roundtrip(spark, sf):
    day = D.day_text(F.col("o_orderdate"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.day_number(day).cast("long").alias("day_num"), F.date_format(D.as_date(day), "yyyy-MM-dd").alias("iso"))


@query("SELECT o_orderkey AS id, ['lunes','martes','miercoles','jueves','viernes','sabado','domingo'][isodow(o_orderdate)] AS weekday, isodow(o_orderdate) = (o_orderkey % 7) + 1 AS holds FROM orders")
def weekday_gate(spark, sf):
    date = F.to_date("o_orderdate")
    named = F.element_at(F.array(*map(F.lit, D.WEEKDAYS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.weekday_name(date).alias("weekday"), D.weekday_holds(date, named).alias("holds"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{TODAY}' - 1 AND DATE '1998-01-04'")
def week_window(spark, sf):
    return read(spark, sf, "orders").where(D.in_week(F.to_date("o_orderdate"), TODAY)).select(F.col("o_orderkey").alias("id"))


# ----------------------------------------------------------------- web pages
_LINES = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr|section|article|header|footer|ul|ol|table|nav|title)>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
_ENT = "{0}"
for _e, _t in T.ENTITIES.items():
    if _e != "&amp;":
        _ENT = "replace({}, '{}', '{}')".format(_ENT, _e, _t.replace("'", "''"))
_ENT = f"replace(regexp_replace(replace({_ENT}, '&amp;', chr(1)), '&[a-zA-Z]+;', ' ', 'g'), chr(1), '&')"


@query("SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(" + _LINES + ", chr(10)), lambda x: trim(regexp_replace(" + _ENT.format("x") + ", '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS lines_md5 FROM pages")
def html_to_lines(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.html_lines(F.col("html"))).alias("lines_md5"))


@query("SELECT page_id, md5(" + _ENT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + ") AS title_md5 FROM pages")
def html_entities(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.entities(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title_md5"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("href"))


@query("WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href FROM l WHERE length(href) > 4 AND href LIKE '/%' AND contains(lower(href), 'e') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY href) <= 5")
def pdf_like_link_filter(spark, sf):
    href = F.col("href")
    found = html_links(spark, sf).distinct().where((F.char_length(href) > 4) & href.startswith("/") & F.contains(F.lower(href), F.lit("e")))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("href"))).where("r <= 5").drop("r")


@query("SELECT page_id, CASE WHEN h LIKE '%.example.org' THEN 'org' WHEN contains(h, 'example.com') THEN 'com' ELSE 'agregador' END AS fuente, h AS host FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^(www|m)\\.', '') AS h FROM pages)")
def source_attribution(spark, sf):
    h = T.host(F.col("url"))
    by = F.coalesce(F.when(h.endswith(".example.org"), "org"), F.when(F.contains(h, F.lit("example.com")), "com"), F.lit("agregador"))
    return read(spark, sf, "pages").select("page_id", by.alias("fuente"), h.alias("host"))


# ---------------------------------------------------------------------- text
@query("SELECT doc_id, md5(" + NORM.format("text") + ") AS norm_md5, length(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS n_compact FROM documents")
def norm_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.words_only(F.col("text"))).alias("norm_md5"), F.length(T.compact(F.col("text"))).cast("long").alias("n_compact"))


@query("SELECT p_partkey, " + SLUG.format("p_name || ' ' || p_type") + " AS slug, array_to_string(list_sort(" + TOKS.format("p_name || ' ' || p_type") + "), ' ') AS toks FROM part")
def tokens_slug(spark, sf):
    c = F.concat_ws(" ", "p_name", "p_type")
    return read(spark, sf, "part").select("p_partkey", T.slug(c).alias("slug"), F.array_join(F.array_sort(T.tokens(c)), " ").alias("toks"))


@query("SELECT p_partkey, levenshtein(upper(string_split(p_type, ' ')[-1]), 'STEEL') AS distance, levenshtein(upper(string_split(p_type, ' ')[-1]), 'STEEL') <= 1 AS alike FROM part")
def edit_distance_word(spark, sf):
    d = F.levenshtein(F.upper(F.element_at(F.split("p_type", " "), -1)), F.lit("STEEL"))
    return read(spark, sf, "part").select("p_partkey", d.cast("long").alias("distance"), (d <= 1).alias("alike"))


@query("SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ':30h de 3.50 e' ELSE '.30 de v2.0' END AS texto FROM orders")
def hours_normalised(spark, sf):
    key = F.col("o_orderkey")
    raw = F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.when(key % 2 == 0, ".30h de 3.50 e").otherwise(".30 de v2.0"))
    return read(spark, sf, "orders").select(key.alias("id"), T.hours(raw).alias("texto"))


@query("SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(20[2-9][0-9])', 1), lambda x: CAST(x AS INT))) AS anyo FROM documents")
def text_year(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.last_number_year(F.col("text")).alias("anyo"))


@query("SELECT doc_id, contains(lower(text), 'there') AS hit FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'src1')")
def text_search(spark, sf):
    return read(spark, sf, "documents").where(F.contains(F.lower(F.concat_ws(" ", "text", "source")), F.lit("src1"))).select("doc_id", F.contains(F.lower("text"), F.lit("there")).alias("hit"))


# ------------------------------------------------------------------- scoring
def rules() -> list[Rule]:
    title, hour = F.col("titulo"), F.substring("hora", 1, 2)
    return [
        Rule("titulo", 3, F.contains(title, F.lit("URGENT")) | F.contains(title, F.lit("HIGH"))),
        Rule("anti", -5, F.contains(title, F.lit("LOW"))),
        *[Rule(f"nombre {n}", 5, F.contains(title, F.lit(n)), group="nombre") for n in SEGMENTS],
        Rule("noche", 1, hour.between("19", "23")),
        Rule("lugar", 1, F.col("lugar").startswith("Plaza")),
    ]


_HITS = "list_filter([CASE WHEN contains(titulo,'URGENT') OR contains(titulo,'HIGH') THEN {'p':3,'r':'titulo'} END, CASE WHEN contains(titulo,'LOW') THEN {'p':-5,'r':'anti'} END, CASE WHEN contains(titulo,'BUILDING') THEN {'p':5,'r':'nombre BUILDING'} WHEN contains(titulo,'MACHINERY') THEN {'p':5,'r':'nombre MACHINERY'} END, CASE WHEN left(hora,2) BETWEEN '19' AND '23' THEN {'p':1,'r':'noche'} END, CASE WHEN starts_with(lugar,'Plaza') THEN {'p':1,'r':'lugar'} END], lambda x: x IS NOT NULL)"
_SCORED = f"{EV}, sc AS (SELECT *, {_HITS} AS h FROM ev), sd AS (SELECT *, CAST(coalesce(list_sum(list_transform(h, lambda x: x.p)), 0) AS INT) AS score FROM sc)"


@query(f"WITH {_SCORED} SELECT id, score, score >= 4 AS aceptado FROM sd")
def score_titles(spark, sf):
    return scored(ev(spark, sf), rules()).select("id", "score", "aceptado")


@query(f"WITH {_SCORED} SELECT id, array_to_string(list_transform(h, lambda x: x.r), '; ') AS motivos FROM sd WHERE score >= 4")
def score_reasons(spark, sf):
    return scored(ev(spark, sf), rules()).where("aceptado").select("id", F.array_join("motivos", "; ").alias("motivos"))


_PRINCIPAL = "CASE " + " ".join(f"WHEN contains(' ' || {NORM.format('titulo')} || ' ', ' {n} ') THEN '{n}'" for n in NAMES[:3]) + " END"


@query(f"WITH {EV} SELECT id, {_PRINCIPAL} AS nombre FROM ev")
def principal_name(spark, sf):
    return ev(spark, sf).select("id", R.dictionary_hit(F.col("titulo"), NAMES[:3]).alias("nombre"))


@query(f"WITH {EV} SELECT nombre, count(*) AS n FROM (SELECT unnest(string_split({NORM.format('titulo')}, ' ')) AS nombre FROM ev) WHERE nombre IN ('automobile','building','furniture','household','machinery') GROUP BY 1")
def dict_hits(spark, sf):
    words = ev(spark, sf).select(F.explode(F.split(T.words_only(F.col("titulo")), " ")).alias("nombre"))
    return words.where(F.col("nombre").isin(NAMES)).groupBy("nombre").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT id, nation.n_name AS resuelto FROM ev LEFT JOIN nation ON {NORM.format('ev.municipio')} = {NORM.format('nation.n_name')}")
def gazetteer_resolve(spark, sf):
    places = read(spark, sf, "nation").select(F.col("n_name").alias("resuelto"), T.words_only(F.col("n_name")).alias("k"))
    return ev(spark, sf).withColumn("k", T.words_only(F.col("municipio"))).join(places, "k", "left").select("id", "resuelto")


# ------------------------------------------------------ keys, merges, pairs
_KEY = f"concat_ws('|', {NORM.format('municipio')}, day, coalesce({_PRINCIPAL}, {SLUG.format('titulo')}))"


def keyed(spark, sf) -> DataFrame:
    e = scored(evb(spark, sf), rules())
    return e.withColumn("clave", R.key(F.col("municipio"), F.col("day"), R.dictionary_hit(F.col("titulo"), NAMES[:3]), F.col("titulo")))


@query(f"WITH {EV} SELECT id, {_KEY} AS clave FROM ev")
def canonical_key(spark, sf):
    return ev(spark, sf).select("id", R.key(F.col("municipio"), F.col("day"), R.dictionary_hit(F.col("titulo"), NAMES[:3]), F.col("titulo")).alias("clave"))


@query(f"WITH {BILL}, k AS (SELECT *, {_KEY} AS clave FROM evb) SELECT clave, arg_min(id, (hora = '', id)) AS id, arg_max(titulo, (length(titulo), hora <> '', -id)) AS titulo, arg_min(hora, (hora = '', id)) AS hora, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(orquestas)))), ',') AS lineup, array_to_string(list_sort(list_distinct(list(fuente))), ',') AS fuentes FROM k GROUP BY clave")
def collapse_by_key(spark, sf):
    c = R.collapse(keyed(spark, sf))
    return c.select("clave", "id", "titulo", "hora", "n", F.array_join("orquestas", ",").alias("lineup"), F.array_join("fuentes", ",").alias("fuentes"))


@query(f"""WITH {BILL}, e AS (SELECT id, municipio, day, lugar, orquestas, {TOKS.format('titulo')} AS toks FROM evb),
p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.toks, b.toks)) AS t, len(list_intersect(a.orquestas, b.orquestas)) AS o,
 len(a.orquestas) > 0 AND len(b.orquestas) > 0 AS bothb, a.lugar <> '' AND b.lugar <> '' AND a.lugar <> b.lugar AS pl FROM e a JOIN e b ON a.municipio = b.municipio AND a.day = b.day AND a.id < b.id)
SELECT id_a, id_b FROM p WHERE NOT ((bothb AND o = 0 AND t < 3) OR (pl AND o < 1 AND t < 3)) AND (o >= 1 OR t >= 2)""")
def fuzzy_pairs(spark, sf):
    return R.fuzzy_pairs(evb(spark, sf))


@query()
def fuzzy_fold(spark, sf):
    return R.fold(evb(spark, sf))


@query()
def greedy_clusters(spark, sf):
    return R.fold(evb(spark, sf), any_member=True)


@query(f"WITH {BILL} SELECT municipio, id, hora FROM evb QUALIFY row_number() OVER (PARTITION BY municipio ORDER BY (hora <> '') DESC, len(orquestas) DESC, length(titulo) DESC, id) = 1")
def keeper_choice(spark, sf):
    return R.keeper(evb(spark, sf), "municipio").select("municipio", "id", "hora")


@query(f"WITH {EV} SELECT municipio, day, id FROM ev QUALIFY row_number() OVER (PARTITION BY municipio, day ORDER BY id) = 1")
def keep_first(spark, sf):
    w = Window.partitionBy("municipio", "day").orderBy("id")
    return ev(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("municipio", "day", "id")


# ---------------------------------------------------------------- aggregates
@query("SELECT p_brand AS nombre, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 2")
def dictionary_build(spark, sf):
    n = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("nombre")).agg(F.count("*").alias("n")).where("n >= 2")
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "nombre")).cast("long"))


def _calendar(spark, sf) -> DataFrame:
    """(municipio, mes, n, total): months are at most twelve for a place."""
    n = ev(spark, sf).groupBy("municipio", F.date_format("fecha", "MM").alias("mes")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("municipio")))


_CAL = f"WITH {EV}, c AS (SELECT municipio, strftime(fecha, '%m') AS mes, count(*) AS n FROM ev GROUP BY 1, 2), cal AS (SELECT *, CAST(sum(n) OVER (PARTITION BY municipio) AS BIGINT) AS total FROM c)"


@query(f"{_CAL} SELECT * FROM cal")
def calendar_build(spark, sf):
    return _calendar(spark, sf)


@query(f"{_CAL} SELECT municipio, array_to_string(list(mes ORDER BY n DESC, mes), ',') AS calientes FROM cal WHERE n >= greatest(2, total * 0.085) GROUP BY 1")
def hot_months(spark, sf):
    hot = _calendar(spark, sf).where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * 0.085))
    return hot.groupBy("municipio").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "mes"))), lambda x: x["mes"]), ",").alias("calientes"))


@query(f"WITH {EV} SELECT municipio, count(*) AS n FROM ev GROUP BY 1")
def counts_by_municipality(spark, sf):
    return ev(spark, sf).groupBy("municipio").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT fuente, count(*) AS n, count(*) FILTER (WHERE fecha >= DATE '{TODAY}') AS futuras, count(*) > 0 AS ok FROM ev GROUP BY 1")
def source_status(spark, sf):
    return ev(spark, sf).groupBy("fuente").agg(F.count("*").alias("n"), F.count_if(F.col("fecha") >= F.lit(TODAY).cast("date")).alias("futuras"), (F.count("*") > 0).alias("ok"))


@query(f"WITH {EV} SELECT fuente, id FROM ev QUALIFY row_number() OVER (PARTITION BY fuente ORDER BY fecha DESC, id) <= 12")
def topk_per_source(spark, sf):
    w = Window.partitionBy("fuente").orderBy(F.desc("fecha"), "id")
    return ev(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 12").select("fuente", "id")


@query(f"WITH {EV} SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS nombre FROM ev JOIN lineitem ON l_orderkey = id JOIN part ON l_partkey = p_partkey WHERE fecha >= DATE '{TODAY}'")
def distinct_bill(spark, sf):
    e = ev(spark, sf).where(F.col("fecha") >= F.lit(TODAY).cast("date"))
    on = e.join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("id")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return on.select(T.compact(F.col("p_brand")).alias("nombre")).distinct()


_ACT = "SELECT user_id, max(ts) AS ultima, datediff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS dias, count(*) FILTER (WHERE event_type = 'error') AS fallos FROM events GROUP BY 1"
_RHYTHM = "CASE WHEN fallos >= 3 THEN 'abandonada' WHEN dias < 7 THEN 'caliente' WHEN dias < 30 THEN 'templada' WHEN dias < 365 THEN 'fria' ELSE 'abandonada' END"


@query(f"SELECT user_id, dias, {_RHYTHM} AS ritmo FROM ({_ACT})")
def last_activity_rhythm(spark, sf):
    a = read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ultima"), F.count_if(F.col("event_type") == "error").alias("fallos"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ultima"))
    return a.select("user_id", days.cast("long").alias("dias"), D.rhythm(days, F.col("fallos")).alias("ritmo"))


@query(f"SELECT ritmo, count(*) AS n FROM (SELECT {_RHYTHM} AS ritmo FROM ({_ACT})) GROUP BY 1")
def rhythm_counts(spark, sf):
    return last_activity_rhythm(spark, sf).groupBy("ritmo").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 10 WHEN 'FURNITURE' THEN 5 ELSE 0 END + CASE WHEN c_acctbal >= 7000 THEN 30 WHEN c_acctbal >= 3000 THEN 15 ELSE 5 END + CASE WHEN c_nationkey = 3 THEN 500 ELSE 0 END AS prioridad FROM customer")
def queue_priority(spark, sf):
    kind = F.when(F.col("c_mktsegment").isin(SEGMENTS), 10).when(F.col("c_mktsegment") == "FURNITURE", 5).otherwise(0)
    pace = F.when(F.col("c_acctbal") >= 7000, 30).when(F.col("c_acctbal") >= 3000, 15).otherwise(5)
    total = kind + pace + F.when(F.col("c_nationkey") == 3, 500).otherwise(0)
    return read(spark, sf, "customer").select("c_custkey", total.alias("prioridad")).orderBy(F.desc("prioridad"), "c_custkey")


# ----------------------------------------------------------- store and state
_HALVES = f"{EV}, st AS (SELECT id, titulo, hora, fecha FROM ev WHERE id % 3 <> 0), ba AS (SELECT id, titulo || '!' AS titulo, nullif(hora, '') AS hora, fecha FROM ev WHERE id % 2 = 0)"


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = ev(spark, sf)
    return e.where("id % 3 <> 0").select("id", "titulo", "hora", "fecha"), e.where("id % 2 = 0").select("id", F.concat("titulo", F.lit("!")).alias("titulo"), F.nullif("hora", F.lit("")).alias("hora"), "fecha")


@query(f"WITH {_HALVES} SELECT coalesce(ba.id, st.id) AS id, coalesce(ba.titulo, st.titulo) AS titulo, coalesce(ba.hora, st.hora) AS hora, coalesce(ba.fecha, st.fecha) AS fecha FROM st FULL JOIN ba ON st.id = ba.id")
def upsert_merge(spark, sf):
    return K.upsert(*_halves(spark, sf))


@query(f"WITH {EV} SELECT id, day FROM ev WHERE fecha >= DATE '{TODAY}'")
def purge(spark, sf):
    return K.purge(ev(spark, sf), "fecha", TODAY).select("id", "day")


@query(f"WITH {_HALVES} SELECT id FROM st WHERE id NOT IN (SELECT id FROM ba)")
def mirror_delete(spark, sf):
    return K.gone(*_halves(spark, sf))


@query(f"WITH {_HALVES} SELECT id, titulo FROM ba WHERE id NOT IN (SELECT id FROM st)")
def novelty(spark, sf):
    stored, batch = _halves(spark, sf)
    return K.novel(batch, stored).select("id", "titulo")


@query("WITH s AS (SELECT event_id, user_id FROM events WHERE event_type = 'error'), n AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, coalesce(n, 0) AS casos, CASE WHEN n IS NULL THEN 'nuevo' WHEN n = 1 THEN 'cancela' ELSE 'ambiguo' END AS accion FROM s LEFT JOIN n USING (user_id)")
def signal_cardinality(spark, sf):
    e = read(spark, sf, "events").withColumn("orquesta", F.col("user_id").cast("string"))
    bill = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "orquesta")
    return C.dispatched(e.where("event_type = 'error'").withColumn("cancela", F.lit(True)), bill).select("event_id", "casos", "accion")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN n_chars >= 1500 WHEN quality = 0 THEN false ELSE n_chars >= 200 END AS pasa FROM documents LEFT JOIN labels USING (doc_id)")
def verdict_three_way(spark, sf):
    passes = F.when(F.col("quality").isNull(), F.col("n_chars") >= 1500).when(F.col("quality") == 0, False).otherwise(F.col("n_chars") >= 200)
    return read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", passes.alias("pasa"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, ts, event_id) = 1")
def best_per_id(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "ts", "event_id")
    return read(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_id", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_MES = "CASE WHEN role = 'user' THEN turn END"


@query(f"SELECT conv_id, turn, coalesce({_MES}, last_value({_MES} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value({_MES} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS mes FROM conversations")
def carry_forward(spark, sf):
    own, w = F.when(F.col("role") == "user", F.col("turn")), Window.partitionBy("conv_id").orderBy("turn")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(own, F.last(own, True).over(back), F.first(own, True).over(ahead)).alias("mes"))


@query("SELECT conv_id, turn, lead(role) OVER w AS siguiente, length(right(lag(text) OVER w, 600)) AS contexto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def next_section(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    tail = F.lag(F.least(F.char_length("text"), F.lit(600))).over(w)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("siguiente"), tail.cast("long").alias("contexto"))


# ------------------------------------------------------------------- streams
@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf):
    return S.drained(S.first_seen(S.landed(spark, sf), "user_id"), "append", "first-seen")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def stream_late_drop(spark, sf):
    return S.drained(S.on_time(S.landed(spark, sf), "2024-01-10"), "append", "late-drop")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf):
    return S.drained(S.hourly(S.landed(spark, sf)), "complete", "hourly").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUN)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
