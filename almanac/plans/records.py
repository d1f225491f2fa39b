"""Queries of the domain operators over texts, posts and accounts that are
projected from the driver's tables, with their DuckDB SQL. The projections are
built of columns, so that SQL knows what has to be read out of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import acts, programmes, social
from almanac.operators import matching as M
from almanac.operators.scoring import scored
from almanac.plans.agenda import BILL, EV, NORM, STOP, TODAY, TOKS, ev, evb, query
from almanac.session import read
from almanac.sources import landing

_LIST = lambda xs: "['" + "','".join(xs) + "']"
_MONTHS, _WEEK = _LIST(D.MONTHS), _LIST(D.WEEKDAYS)
_FOLDED = "lower(strip_accents({0}))"


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


# ---------------------------------------------------------------- programmes
_PROG = f"""prog AS (
 SELECT o_orderkey AS id, o_orderkey % 28 + 1 AS d, o_orderkey % 12 + 1 AS m, 2020 + o_orderkey % 10 AS y, o_orderkey * 3 % 28 + 1 AS d2, c_mktsegment AS s,
  {_WEEK}[o_orderkey % 7 + 1] || ' ' || (o_orderkey % 28 + 1) || ' de ' || {_MONTHS}[o_orderkey % 12 + 1] || ' de ' || (2020 + o_orderkey % 10)
   || chr(10) || '21.30h Gran verbena con la Orquesta ' || c_mktsegment || ' en la Plaza Mayor. 23:00 misa. ' AS a,
  'A su término, fuegos. ' || (o_orderkey * 3 % 28 + 1) || ' ' || {_WEEK}[(o_orderkey + 3) % 7 + 1] || ' gala. Inscripción hasta el 3 de mayo' AS b
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def programmes_of(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    num = lambda c: c.cast("string")
    text = F.concat(
        pick(D.WEEKDAYS, k % 7), F.lit(" "), num(k % 28 + 1), F.lit(" de "), pick(D.MONTHS, k % 12), F.lit(" de "), num(2020 + k % 10),
        F.lit("\n21.30h Gran verbena con la Orquesta "), "c_mktsegment", F.lit(" en la Plaza Mayor. 23:00 misa. "),
        F.lit("A su término, fuegos. "), num(k * 3 % 28 + 1), F.lit(" "), pick(D.WEEKDAYS, (k + 3) % 7), F.lit(" gala. Inscripción hasta el 3 de mayo"),
    )
    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(k.alias("id"), text.alias("texto"))


@query(f"WITH {_PROG} SELECT id, 0 AS ord, 0 AS pos, d AS dia, lpad(m::VARCHAR, 2, '0') AS mes, y::VARCHAR AS anyo, a AS texto FROM prog UNION ALL SELECT id, 1, length(a), d2, '', '', b FROM prog")
def programme_sections(spark, sf):
    s = programmes.sections(programmes_of(spark, sf), "id", "texto")
    return s.select("id", "ord", "pos", F.col("dia").cast("long").alias("dia"), "mes", "anyo", "texto")


@query(f"WITH {_PROG} SELECT id, 0 AS ord, strftime(make_date(y, m, d), '%d-%m-%Y') AS day FROM prog UNION ALL SELECT id, 1, strftime(make_date(y, m, d2), '%d-%m-%Y') FROM prog")
def programme_days(spark, sf):
    return acts.dated(programmes_of(spark, sf), "id", "texto").select("id", "ord", "day")


@query(f"WITH {_PROG} SELECT id, strftime(make_date(y, m, d), '%d-%m-%Y') AS day, '21:30' AS hora, 'Plaza Mayor' AS lugar, 'Gran verbena con la Orquesta ' || s || ' en la Plaza Mayor' AS titulo, s AS nombres FROM prog")
def programme_acts(spark, sf):
    found = acts.acts(programmes_of(spark, sf), "id", "texto")
    return found.select("id", "day", "hora", "lugar", "titulo", F.array_join("orquestas", ",").alias("nombres"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ',Uno,Dos' WHEN 1 THEN c_mktsegment || ' y Uno' WHEN 2 THEN c_mktsegment || ',Uno,Dos' ELSE '' END AS nombres FROM customer")
def line_ups(spark, sf):
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    title = (
        F.when(k == 0, F.concat(F.lit("Verbena con el Grupo "), s, F.lit(", Uno y la Orquesta Dos"))).when(k == 1, F.concat(F.lit("Orquesta "), s, F.lit(" y Uno, Plaza del Sol")))
        .when(k == 2, F.concat(F.lit("Noche amenizada por las orquestas "), s, F.lit(", Uno y Dos. Sorteo"))).otherwise(F.lit("Baile con entrega de Premios"))
    )
    return read(spark, sf, "customer").select("c_custkey", F.array_join(programmes.line_up(title), ",").alias("nombres"))


# -------------------------------------------------------------- titles, posts
TITLES = ["Gran Verbena", "Baile de Magos", "Taller infantil", "Noche en Blanco", "Romería", "Misa y procesión", "Fiestas de mayo", "Tardeo con Building", "Baile de la Virgen", "Fiesta inclusiva"]
TEXTS = ["", "Amenizado por Machinery", "Misa a las 12:00", "Rosario y gran baile a las 22:00", "Orquesta: Building", "Con parranda a las 21:00"]
_TT = f"tt AS (SELECT o_orderkey AS id, {_LIST(TITLES)}[o_orderkey % 10 + 1] AS titulo, {_LIST(TEXTS)}[o_orderkey % 6 + 1] AS texto, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' END AS hora, CASE WHEN o_orderkey % 3 = 0 THEN 'Casa' ELSE 'Plaza X' END AS lugar, CASE WHEN o_orderkey % 11 = 0 THEN 6 ELSE 0 END AS extra FROM orders), tf AS (SELECT *, {_FOLDED.format('titulo')} AS t, {_FOLDED.format('texto')} AS x FROM tt)"


def titled(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    hour = F.when(k % 5 == 0, "").otherwise(F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00")))
    return read(spark, sf, "orders").select(k.alias("id"), pick(TITLES, k % 10).alias("titulo"), pick(TEXTS, k % 6).alias("texto"), hour.alias("hora"), F.when(k % 3 == 0, "Casa").otherwise("Plaza X").alias("lugar"), F.when(k % 11 == 0, 6).otherwise(0).alias("extra"))


@query(f"WITH {_TT} SELECT id, CASE WHEN contains(t, 'baile de magos') THEN 'Baile Magos' WHEN contains(t, 'baile de taifa') THEN 'Taifa' WHEN contains(t, 'romeria') THEN 'Romería' WHEN contains(t, 'inclusiva') THEN 'Inclusiva' WHEN regexp_matches(t, 'noche latina|noche boricua|noche en blanco|latinazo|tributo|studio 54|concierto|festival') THEN 'Concierto' WHEN regexp_matches(t, 'baile|tardeo|verbena') THEN 'Baile Normal' WHEN regexp_matches(t, 'fiestas mayores|fiestas de') THEN 'Fiestas' ELSE 'Otro' END AS tipo FROM tf")
def event_kinds(spark, sf):
    return titled(spark, sf).select("id", social.event_kind(F.col("titulo")).alias("tipo"))


_ANTI = r"\b(" + "|".join(social.ANTI) + r")\b"
_POINTS = rf"""CASE WHEN regexp_matches(t, '\b({'|'.join(social.TITLE)})\b') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(t, '\binfantil\b|\bfamiliar\b|bebecuento|hinchables?|tercera edad|tercera juventud|\bmayores\b') THEN -4 ELSE 0 END
 + CASE WHEN regexp_matches(t, '{_ANTI}') THEN -5 ELSE 0 END + CASE WHEN regexp_matches(t, 'building|machinery') THEN 5 ELSE 0 END + extra
 + CASE WHEN regexp_matches(x, 'amenizado por|amenizan|orquestas?\s*:|orquestas?\s+[a-z]|gran baile|noche latina') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(x[1:500], '{_ANTI}') AND extra = 0 AND NOT regexp_matches(x, 'gran baile|amenizado') THEN -3 ELSE 0 END
 + CASE WHEN regexp_matches(t, 'virgen|aleluya|eucaristia|misa del pueblo') AND NOT regexp_matches(t || ' ' || x[1:300], 'amenizado|orquesta|grupo|dj|parranda|tributo') THEN -6 ELSE 0 END
 + CASE WHEN (contains(x, 'building') AND NOT contains(t, 'building')) OR (contains(x, 'machinery') AND (contains(t, 'building') OR NOT contains(t, 'machinery'))) THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(CASE WHEN hora <> '' THEN hora ELSE x[1:500] END, '(19|2[0-3]):\d\d') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(lugar), 'plaza|parque|recinto|casco') THEN 1 ELSE 0 END"""


@query(f"WITH {_TT}, sc AS (SELECT id, CAST({_POINTS} AS INT) AS score FROM tf) SELECT id, score, score >= 4 AS aceptado FROM sc")
def event_scores(spark, sf):
    rules = social.event_rules(["Building", "Machinery"], F.col("titulo"), F.col("texto"), F.col("hora"), F.col("lugar"), F.col("extra"))
    return scored(titled(spark, sf), rules).select("id", "score", "aceptado")


#: What a post tells of its age, and the days that is (999: nothing known).
_AGES = [
    ("20 minutos", 0), ("10min", 0), ("3 h", 0), ("12 h.", 0), ("3 horas", 999), ("12 hs", 999), ("2 semanas", 14), ("1 sem.", 7), ("3 SEM", 21),
    ("4 d", 4), ("7d", 7), ("2 días", 2), ("2 dias", 999), ("Hoy mismo", 0), ("hoyos", 0), ("Ayer a las 9", 1), ("ayer, hace 3 d", 1), ("hace 5 d y 2 sem", 5),
    ("1 d y 3 min", 0), ("3 sem, hoy", 0), ("3 sem, ayer", 1), ("hace tiempo", 999), ("", 999), ("hace 12 meses", 999), ("d 4", 999), ("2 de foo", 999), ("3 dic", 999), ("1234 d", 1234),
]
_POSTED = "CAST(o_orderdate AS DATE)"


def _case(key: str, values: list[str]) -> str:
    """SQL that picks by key modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _latest(day: int, month: int, ahead: int) -> str:
    same = f"make_date(year({_POSTED}), {month}, {day})"
    return f"(CASE WHEN {same} <= {_POSTED} + {ahead} THEN {same} ELSE make_date(year({_POSTED}) - 1, {month}, {day}) END)"


_TOLD_DATES = [("15 de ago.", 15, 8), ("20 de dic.", 20, 12), ("1 de enero", 1, 1), ("3 de sept.", 3, 9), ("9deMarzo", 9, 3)]
_AGE_SQL = [str(n) for _, n in _AGES] + [f"date_diff('day', {_latest(d, m, 0)}, {_POSTED})" for _, d, m in _TOLD_DATES]


@query(f"SELECT o_orderkey AS id, CAST({_case('o_orderkey', _AGE_SQL)} AS INT) AS dias FROM orders")
def post_ages(spark, sf):
    told = pick([t for t, *_ in [*_AGES, *_TOLD_DATES]], F.col("o_orderkey") % len(_AGE_SQL))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), social.post_age(told, F.to_date("o_orderdate")).cast("int").alias("dias"))


_DOW = f"CAST(isodow({_POSTED}) - 1 AS INT)"
_THIS = [f"{_POSTED} + ({i} - {_DOW})" for i in range(7)]
_NEXT = [f"{_POSTED} + (({i} - {_DOW} + 6) % 7 + 1)" for i in range(7)]
_NONE, _TODAY, _TOMORROW, _AFTER = "NULL", _POSTED, f"{_POSTED} + 1", f"{_POSTED} + 2"
#: What a post says, and the day that is.
_SAID = [
    ("Esta noche, baile", _TODAY), ("Mañana, y no esta tarde", _TODAY), ("El viernes gran verbena; esta noche ensayo", _TODAY), ("HOY no, mañana sí", _TODAY), ("esta mañana temprano", _TODAY),
    ("Pasado mañana gala", _AFTER), ("mañana es pasado mañana menos uno", _AFTER), ("Mañana por la mañana", _TOMORROW), ("por la mañana, el lunes", _TOMORROW), ("amañana", _NONE), ("hoyo en la carretera", _NONE),
    ("este finde fiesta", _THIS[5]), ("este fin de semana o el martes", _THIS[5]), ("el lunes y este domingo", _THIS[6]), ("Este miércoles, 3 de octubre", _THIS[2]), ("ESTE LUNES", _THIS[0]),
    ("nos vemos el viernes", _NEXT[4]), ("el SÁBADO", _NEXT[5]), ("hasta el lunes, y el martes cierre", _NEXT[1]), ("el jueves 3 de octubre", _NEXT[3]), ("fue el  domingo", _NEXT[6]),
    ("hasta el lunes", _NONE), ("del sábado", _NONE), ("el sabadoo", _NONE), ("", _NONE), ("viernes", _NONE), ("día 3", _NONE), ("3 de nada", _NONE),
    ("3 de octubre", _latest(3, 10, 180)), ("el 10 de enero del próximo", _latest(10, 1, 180)), ("31 de diciembre de 2030", _latest(31, 12, 180)), ("1deSetiembre", _latest(1, 9, 180)), ("hasta el miércoles 23 de junio", _latest(23, 6, 180)),
]


@query(f"SELECT o_orderkey AS id, CAST({_case('o_orderkey', [v for _, v in _SAID])} AS DATE) AS day FROM orders")
def event_days(spark, sf):
    said = pick([t for t, _ in _SAID], F.col("o_orderkey") % len(_SAID))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), social.event_day(said, F.to_date("o_orderdate")).alias("day"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN false WHEN quality IS NULL AND doc_id % 2 = 0 THEN doc_id % 7 >= 4 ELSE coalesce(quality = 1, false) END AS pasa FROM documents LEFT JOIN labels USING (doc_id)")
def post_verdicts(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return docs.select("doc_id", social.verdict(F.col("doc_id") % 7, F.col("quality") == 1, F.col("doc_id") % 2 == 1).alias("pasa"))


@query("SELECT page_id, '/docs/Programa-fiestas-' || (2020 + page_id % 3) || '.pdf' AS href FROM pages WHERE page_id % 3 = 1")
def program_links(spark, sf):
    p = read(spark, sf, "pages")
    link = F.concat(F.lit('<a href="/docs/Programa-fiestas-'), (2020 + F.col("page_id") % 3).cast("string"), F.lit('.pdf">x</a><a href="/docs/2021.pdf">y</a><a href="/programa-2021.html">z</a>'))
    return landing.program_links(p.select(F.col("page_id").alias("url"), F.concat("html", link).alias("html")), 2021).select(F.col("url").alias("page_id"), "href")


@query("SELECT page_id, lower('User' || page_id) AS cuenta, '/p/' || page_id || ' x' AS ruta FROM pages")
def account_urls(spark, sf):
    n = F.col("page_id").cast("string")
    wrapped = F.concat(F.lit("https://l.x.com/l.php?h=1&u=https%3A%2F%2Fwww.x.com%2Fp%2F"), n, F.lit("%20x&z=2"))
    return read(spark, sf, "pages").select("page_id", T.handle(F.concat(F.lit("https://www.x.com/User"), n, F.lit("/posts"))).alias("cuenta"), F.regexp_extract(T.unwrapped(wrapped), "com(/.*)$", 1).alias("ruta"))


@query("SELECT page_id, 'a' || chr(CAST(200 + page_id % 50 AS INT)) || 'b' || chr(CAST(8364 + page_id % 9 AS INT)) AS texto FROM pages")
def numeric_entities(spark, sf):
    n = F.col("page_id")
    raw = F.concat(F.lit("a&#"), (200 + n % 50).cast("string"), F.lit(";b&#x"), F.lower(F.hex(8364 + n % 9)), F.lit(";"))
    return read(spark, sf, "pages").select("page_id", T.entities(raw).alias("texto"))


_TIMES = lambda m: f"len(regexp_extract_all({_FOLDED.format('texto')}, '[0-9]+ de {m}\\b'))"


@query(f"WITH {_PROG}, p AS (SELECT id, a || b AS texto, lpad(m::VARCHAR, 2, '0') AS mes FROM prog) SELECT id, CASE WHEN {_TIMES('mayo')} >= 1 AND mes > '05' THEN '05' ELSE mes END AS mes FROM p")
def month_mode(spark, sf):
    return programmes_of(spark, sf).select("id", M.most_named_month(F.col("texto")).alias("mes"))


# ------------------------------------------------------ matching and changes
_TWO = f"{BILL}, st AS (SELECT * FROM evb WHERE id % 3 <> 0), ba AS (SELECT id, CASE WHEN id % 4 = 0 THEN titulo || ' Nuevo' ELSE upper(titulo) END AS titulo, hora, orquestas FROM evb WHERE id % 2 = 0)"


def _two(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = evb(spark, sf)
    title = F.when(F.col("id") % 4 == 0, F.concat("titulo", F.lit(" Nuevo"))).otherwise(F.upper("titulo"))
    return e.where("id % 3 <> 0"), e.where("id % 2 = 0").select("id", title.alias("titulo"), "hora", "orquestas")


@query(f"WITH {_TWO} SELECT ba.id FROM ba LEFT JOIN st ON ba.id = st.id WHERE st.id IS NULL OR ba.id % 4 = 0")
def changed_rows(spark, sf):
    return M.changed(*_two(spark, sf)).select("id")


@query(f"WITH {_TWO}, f AS (SELECT id, ['Nuevo'] AS nombres, '23:00' AS hora2, id % 9 AS score2 FROM ba) SELECT st.id, array_to_string(CASE WHEN f.id IS NULL THEN orquestas ELSE list_append(orquestas, 'Nuevo') END, ',') AS nombres, CASE WHEN hora = '' AND f.id IS NOT NULL THEN hora2 ELSE hora END AS hora, CAST(greatest(4, score2) AS BIGINT) AS score FROM st LEFT JOIN f ON st.id = f.id")
def enrichment(spark, sf):
    stored, batch = _two(spark, sf)
    found = batch.select("id", F.array(F.lit("Nuevo")).alias("orquestas"), F.lit("23:00").alias("hora"), (F.col("id") % 9).alias("score"))
    out = M.enriched(stored.withColumn("score", F.lit(4).cast("long")), found, united=("orquestas",), filled=("hora",))
    return out.select("id", F.array_join("orquestas", ",").alias("nombres"), "hora", "score")


_SUB = f"{EV}, s AS (SELECT id, municipio AS programa, 'Acto ' || (id % 5) AS titulo, day, hora, id % 3 AS lectura, id % 50 = 0 AS promovido FROM ev), l AS (SELECT *, max(lectura) OVER (PARTITION BY programa, titulo) AS ultima FROM s)"


@query(f"WITH {_SUB} SELECT id FROM l WHERE lectura = ultima OR promovido QUALIFY row_number() OVER (PARTITION BY programa, titulo, day, hora ORDER BY promovido DESC, id) = 1")
def substitution(spark, sf):
    k = F.col("id")
    s = ev(spark, sf).select("id", F.col("municipio").alias("programa"), F.concat(F.lit("Acto "), (k % 5).cast("string")).alias("titulo"), "day", "hora", (k % 3).alias("lectura"), (k % 50 == 0).alias("promovido"))
    return M.substituted(s).select("id")


_CAND = f"{BILL}, e AS (SELECT id, day, municipio, orquestas, {TOKS.format('titulo')} AS toks FROM evb WHERE id % 2 = 0), c AS (SELECT id, day, CASE WHEN id % 3 = 0 THEN '' ELSE municipio END AS municipio, orquestas[1:1] AS orquestas, {TOKS.format('titulo')} AS toks FROM evb WHERE id % 2 = 1)"


@query(f"WITH {_CAND}, p AS (SELECT c.id, e.id AS evento FROM c JOIN e ON c.day = e.day AND (c.municipio = '' OR c.municipio = e.municipio) WHERE len(list_intersect(c.orquestas, e.orquestas)) >= 1 OR (c.municipio <> '' AND len(list_intersect(c.toks, e.toks)) >= 2)), n AS (SELECT id, count(*) AS casos, min(evento) AS evento FROM p GROUP BY 1) SELECT c.id, coalesce(casos, 0) AS casos, CASE WHEN casos = 1 THEN evento END AS evento, CASE WHEN casos IS NULL THEN 'nuevo' WHEN casos = 1 THEN 'completa' ELSE 'ambiguo' END AS accion FROM c LEFT JOIN n USING (id)")
def candidate_cross(spark, sf):
    e = evb(spark, sf)
    c = e.where("id % 2 = 1").withColumn("municipio", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("municipio"))).withColumn("orquestas", F.slice("orquestas", 1, 1))
    return M.candidate_matches(c, e.where("id % 2 = 0"))


@query(f"WITH t AS (SELECT doc_id, string_split({NORM.format('text')}, ' ') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t), g AS (SELECT unnest(['the','and','lich','que','les']) AS token, unnest(['A','B','C','D','E']) AS lugar), f AS (SELECT doc_id, arg_min(lugar, pos) AS lugar FROM x JOIN g USING (token) GROUP BY 1) SELECT doc_id, lugar FROM documents LEFT JOIN f USING (doc_id)")
def gazetteer_tokens(spark, sf):
    places = spark.createDataFrame(list(zip(["the", "and", "lich", "que", "les"], "ABCDE", strict=True)), "token string, lugar string")
    return M.first_place(read(spark, sf, "documents"), "doc_id", "text", places)


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'url' ELSE 'handle' END AS municipio FROM events")
def account_places(spark, sf):
    e, user = read(spark, sf, "events"), F.col("user_id")
    posts = e.select(F.col("event_id").alias("id"), F.when(user % 2 == 0, F.concat(F.lit("u"), user.cast("string"))).alias("url"), F.concat(F.lit("h"), user.cast("string")).alias("handle"))
    users = e.where(user % 5 != 0).select("user_id").distinct()
    accounts = users.select(user.alias("id"), F.concat(F.lit("u"), user.cast("string")).alias("url"), F.lit(None).cast("string").alias("handle"), F.lit("url").alias("municipio")).union(users.select(user + 1_000_000, F.lit(None).cast("string"), F.concat(F.lit("h"), user.cast("string")), F.lit("handle")))
    return M.account_place(posts, accounts).select(F.col("id").alias("event_id"), "municipio")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE l.quality = 1 END AS relevante, coalesce(l.quality IS NOT NULL AND d.doc_id % 4 <> 0, false) AS visto FROM documents d LEFT JOIN labels l USING (doc_id)")
def verdict_cache(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("texto_hash"), "text")
    known = docs.join(read(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    hash_ = F.when(F.col("id") % 4 == 0, F.lit("old")).otherwise(F.col("texto_hash"))
    verdicts = known.select("id", hash_.alias("texto_hash"), (F.col("quality") == 1).alias("relevante"), F.lit(2).alias("at"))
    verdicts = verdicts.union(known.select("id", hash_, F.lit(False), F.lit(1)))
    return M.with_verdicts(docs, verdicts).select(F.col("id").alias("doc_id"), "relevante", "visto")


_CALM = "SELECT n_name AS municipio, strftime(o_orderdate, '%m') AS mes, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def _accounts(spark, sf) -> DataFrame:
    a = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return a.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Fiestas de "), F.initcap("n_name")).alias("nombre"), F.col("n_name"), F.col("s_acctbal"), F.col("s_nationkey"))


_HOT = f"hot AS (SELECT municipio, n >= greatest(2, sum(n) OVER (PARTITION BY municipio) * 0.085) AS caliente, mes FROM ({_CALM})), tok AS (SELECT n_name AS municipio, unnest(string_split({NORM.format('n_name')}, ' ')) AS w FROM nation), met AS (SELECT s_suppkey AS id, min(t2.municipio) AS municipio FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN tok t1 ON t1.municipio = n_name JOIN tok t2 ON t1.w = t2.w WHERE len(t1.w) > 3 AND t2.municipio IN (SELECT municipio FROM hot) GROUP BY 1)"


def _season(spark, sf) -> DataFrame:
    from almanac.plans.agenda import _calendar

    cal = _calendar(spark, sf).withColumn("caliente", F.col("n") >= F.greatest(F.lit(2), F.col("total") * 0.085))
    return M.in_season(_accounts(spark, sf), cal, "07")


@query(f"WITH {_HOT} SELECT id, municipio, coalesce((SELECT max(caliente) FROM hot WHERE hot.municipio = met.municipio AND mes = '07'), false) AS caliente FROM met")
def accounts_in_season(spark, sf):
    return _season(spark, sf)


_PRIO = f"WITH {_HOT}, s AS (SELECT id, coalesce((SELECT max(caliente) FROM hot WHERE hot.municipio = met.municipio AND mes = '07'), false) AS c FROM met), q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END + CASE WHEN s_acctbal >= 7000 THEN 30 WHEN s_acctbal >= 3000 THEN 15 ELSE 5 END + CASE WHEN s_nationkey = 3 THEN 500 ELSE 0 END + CASE WHEN contains(lower(n_name), 'ira') THEN 200 ELSE 0 END + CASE WHEN c THEN 100 ELSE 0 END AS prioridad FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN s ON s.id = s_suppkey)"


@query(f"{_PRIO} SELECT s_suppkey, CAST(prioridad AS INT) AS prioridad, row_number() OVER (ORDER BY prioridad DESC, s_suppkey) AS puesto FROM q")
def account_queue(spark, sf):
    """Ranked over all accounts: a table of hundreds, so one task orders it."""
    from pyspark.sql import Window

    a = _accounts(spark, sf).join(_season(spark, sf).select("id", "caliente"), "id", "left")
    kind = pick(["ayuntamiento", "comision", "otro"], F.col("id") % 3)
    pace = F.when(F.col("s_acctbal") >= 7000, "caliente").when(F.col("s_acctbal") >= 3000, "templada").otherwise("fria")
    points = M.queue_priority(kind, pace, F.col("s_nationkey") == 3, M.boosted(F.col("n_name"), ["irak", "iran", "iraq"]), F.coalesce("caliente", F.lit(False)))
    return a.select(F.col("id").alias("s_suppkey"), points.cast("int").alias("prioridad")).withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("prioridad"), "s_suppkey")).cast("long"))


@query("WITH a AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'click'), u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 0 FROM b) SELECT user_id, max(ts) AS at FROM u GROUP BY 1")
def fresher_wins(spark, sf):
    e = read(spark, sf, "events")
    last = lambda kind: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("at"))
    return M.fresher(last("view"), last("click")).select(F.col("id").alias("user_id"), "at")


@query(f"WITH {EV} SELECT id, row_number() OVER (PARTITION BY municipio ORDER BY fecha, CASE WHEN hora = '' THEN '99' ELSE hora END, id) AS puesto FROM ev WHERE fecha >= DATE '{TODAY}'")
def agenda_ranks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("municipio").orderBy(D.as_date(F.col("day")).asc_nulls_last(), F.nullif("hora", F.lit("")).asc_nulls_last(), "id")
    return ev(spark, sf).where(D.is_future(F.col("day"), TODAY)).select("id", F.row_number().over(w).cast("long").alias("puesto"))
