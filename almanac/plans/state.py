"""Queries of what is kept between runs: failures in a row, states of events,
the keyed store; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.operators import dictionary as N
from almanac.operators import lifecycle as C
from almanac.operators import merge as M
from almanac.operators import spelling as S
from almanac.operators import versions as V
from almanac.plans.agenda import query
from almanac.session import read, shared_dir
from almanac.streaming import events as E

_RUNS = "SELECT user_id, max(ts) AS ultima, count(*) FILTER (WHERE ok_since = 0) AS fallos FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS ok_since FROM events) GROUP BY 1"


@query(f"SELECT user_id, fallos::BIGINT AS fallos, CASE WHEN fallos >= 3 THEN 'abandonada' WHEN datediff('day', ultima::DATE, DATE '2024-02-01') < 7 THEN 'caliente' WHEN datediff('day', ultima::DATE, DATE '2024-02-01') < 30 THEN 'templada' ELSE 'fria' END AS ritmo FROM ({_RUNS})")
def account_rhythm(spark, sf):
    """Readings of accounts, summed up by day and merged in order."""
    e = read(spark, sf, "events")
    runs = C.failure_runs(e, "user_id", F.struct("ts", "event_id"), F.col("event_type") == "error", F.to_date("ts"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("ultima"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ultima"))
    return C.merged_runs(runs, "user_id").join(last, "user_id").select("user_id", F.col("detras").alias("fallos"), D.rhythm(days, F.col("detras")).alias("ritmo"))


_KIND = "CASE event_type WHEN 'error' THEN 'cancela' WHEN 'view' THEN 'posible' WHEN 'signup' THEN 'retoma' END"
_STATES = f"""WITH s AS (SELECT DISTINCT user_id AS id, ts AS t, {_KIND} AS tipo, 'u' || event_id AS url FROM events WHERE event_type IN ('error', 'view', 'signup') AND ts < DATE '2024-01-25' + (user_id % 9)::INT + 1),
f AS (SELECT *, tipo = 'retoma' AND coalesce(last_value(CASE WHEN tipo <> 'posible' THEN tipo END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t, tipo, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'cancela' AS undone FROM s),
p AS (SELECT *, sum(undone::INT) OVER (PARTITION BY id ORDER BY t, tipo, url) AS part FROM f),
l AS (SELECT p.* FROM p JOIN (SELECT id, max(part) AS part FROM p GROUP BY 1) m USING (id, part))
SELECT id, CASE WHEN arg_max(CASE WHEN tipo <> 'posible' THEN tipo END, (t, tipo, url)) FILTER (WHERE tipo <> 'posible') = 'cancela' THEN 'cancelado' ELSE 'activo' END AS estado,
 coalesce(bool_or(tipo = 'posible'), false) AS posible, arg_max(url, (t, tipo, url)) FILTER (WHERE tipo <> 'retoma') AS motivo FROM l GROUP BY id"""


def _signals(df):
    kind = F.when(F.col("event_type") == "error", "cancela").when(F.col("event_type") == "view", "posible").when(F.col("event_type") == "signup", "retoma")
    day = F.date_add(F.lit("2024-01-25").cast("date"), (F.col("user_id") % 9).cast("int"))
    rows = df.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("tipo"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), day.alias("dia"))
    return rows.where(F.col("tipo").isNotNull())


@query(_STATES)
def event_states(spark, sf):
    rows = _signals(read(spark, sf, "events"))
    return C.states(rows.where(F.to_date("at") <= F.col("dia")))


@query(_STATES)
def stream_event_states(spark, sf):
    return C.newest(E.drained(C.tracked(_signals(E.landed(spark, sf))), "append", "states"))


@query("SELECT doc_id, count(DISTINCT p_type) AS n FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) d JOIN (SELECT DISTINCT p_type FROM part UNION SELECT unnest(['the', 'de la', 'und', 'in the'])) p ON contains(t, ' ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' ') GROUP BY 1")
def names_in_documents(spark, sf):
    kinds = read(spark, sf, "part").select(F.col("p_type").alias("nombre")).distinct()
    known = kinds.unionByName(spark.createDataFrame([(n,) for n in ("the", "de la", "und", "in the")], "nombre string")).select(F.pmod(F.xxhash64("nombre"), F.lit(1_000_000_000)).cast("int").alias("rango"), "nombre")
    found = N.hits(read(spark, sf, "documents"), "doc_id", F.col("text"), known)
    return found.groupBy("doc_id").agg(F.count_distinct("nombre").alias("n"))


@query("WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(p_name, '[A-Za-z]+'))) AS palabra FROM part), n AS (SELECT DISTINCT lower(regexp_extract(n_name, '[A-Za-z]+')) AS nombre FROM nation UNION SELECT palabra[2:] FROM w UNION SELECT palabra || 's' FROM w) SELECT palabra, nombre, levenshtein(palabra, nombre)::INT AS distancia FROM w, n WHERE levenshtein(palabra, nombre) <= 1")
def misspelt_words(spark, sf):
    words = read(spark, sf, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), F.lit(0))).alias("p")).select(F.lower("p").alias("palabra")).distinct()
    names = read(spark, sf, "nation").select(F.lower(F.regexp_extract("n_name", "[A-Za-z]+", 0)).alias("nombre"))
    more = words.select(F.expr("substring(palabra, 2)").alias("nombre")).union(words.select(F.concat("palabra", F.lit("s"))))
    return S.near(words, names.union(more).distinct())


_BATCH = "SELECT o_orderkey AS id, 'k' || (o_custkey % 400) AS clave, o_orderkey % 3 AS part, o_orderstatus AS s, CAST(o_orderkey % 9 AS INT) AS score FROM orders"


@query(f"WITH b AS ({_BATCH}) SELECT clave, min(lpad(id::VARCHAR, 12, '0')) FILTER (WHERE part = first) AS id, CAST(max(score) AS INT) AS score, count(DISTINCT part) AS fuentes FROM (SELECT *, min(part) OVER (PARTITION BY clave) AS first FROM b) GROUP BY clave")
def keyed_store(spark, sf):
    """Three sources one after the other into an empty store, each batch twice."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for number, part in enumerate(stored_batches(spark, sf)):
        for _ in range(2):
            M.apply_batch(spark, root, part, f"s{number}", "orders", number, "2026-01-01", number)
    return V.read(spark, root, M.STORED).select("clave", "id", "score", F.size("fuentes").cast("long").alias("fuentes"))


def stored_batches(spark, sf) -> list:
    """Orders as three batches of events, by their keys."""
    o = read(spark, sf, "orders")
    id_ = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    none = F.array().cast("array<string>")
    told = {"id": id_, "titulo": F.col("o_orderpriority"), "day": F.lit("01-01-2030"), "hora": F.lit(""), "municipio": F.lit("m"), "lugar": F.lit(""), "orquestas": none, "tipo": F.lit("Otro"), "url": F.lit(""), "score": (F.col("o_orderkey") % 9).cast("int"), "motivos": none, "clave": F.concat(F.lit("k"), (F.col("o_custkey") % 400).cast("string")), "n": F.col("o_orderkey")}
    batch = o.select(*[v.alias(c) for c, v in told.items()], "o_orderkey")
    return [batch.where(F.col("o_orderkey") % 3 == number).drop("o_orderkey") for number in (0, 1, 2)]
