"""Queries of archives, of names in a language's order and of a run's state, with
their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import lifecycle as C
from almanac.operators import matching as X
from almanac.operators import merge as M
from almanac.operators import order as O
from almanac.operators import status as U
from almanac.plans.agenda import EV, ev, query
from almanac.plans.state import stored_batches
from almanac.session import read, shared_dir
from almanac.sources import archive as A

# ------------------------------------------------------------------- archives
# A customer's orders are one archive of the shape of its number; some orders lack
# a day, or tell a score that is no number; some archives are cut off.
_ITEMS = "it AS (SELECT 'c' || o_custkey AS archivo, o_custkey AS c, o_orderkey AS k, o_orderpriority AS titulo, n_name AS municipio, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 13 = 0 THEN 'no json' WHEN o_orderkey % 11 = 0 THEN 'no day' WHEN o_orderkey % 7 = 0 THEN 'bad score' END AS motivo FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    score = F.when(k % 7 == 0, "muchos").otherwise((k % 9).cast("string"))
    old = F.struct(F.col("o_orderpriority").alias("titulo"), day.alias("day"), F.col("n_name").alias("municipio"), score.alias("score"))
    new = F.struct(F.col("o_orderpriority").alias("title"), day.alias("fecha"), F.concat(F.col("n_name"), F.lit(" ")).alias("municipio"), score.alias("score"), F.struct(F.col("o_totalprice").alias("precio")).alias("mas"))
    item = F.when(k % 2 == 0, F.to_json(old)).otherwise(F.to_json(new))
    many = rows.select("o_custkey", k.alias("k"), item.alias("j")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "j"))).alias("x"))
    row = F.array_join(F.transform("x", lambda x: x["j"]), ",")
    keyed = F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["k"].cast("string"), F.lit('":'), x["j"])), ",")
    c = F.col("o_custkey")
    text = F.when(c % 3 == 0, F.concat(F.lit("["), row, F.lit("]"))).when(c % 3 == 1, F.concat(F.lit('{"v":2,"events":['), row, F.lit("]}"))).otherwise(F.concat(F.lit("{"), keyed, F.lit("}")))
    whole = F.when(c % 13 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return many.withColumn("text", text).select(F.concat(F.lit("c"), c.cast("string")).alias("archivo"), whole.alias("value"))


@query(f"WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN c % 3 = 2 THEN k::VARCHAR ELSE lpad(k::VARCHAR, 20, '0') END) - 1 AS pos FROM it WHERE c % 13 > 0) SELECT CASE WHEN c % 3 = 2 THEN k::VARCHAR ELSE archivo || '#' || pos END AS id, archivo, titulo, strftime(day, '%Y-%m-%d') AS day, trim(municipio) AS municipio, CAST(k % 9 AS INT) AS score, k % 2 = 1 AS mas FROM n WHERE motivo IS NULL")
def archive_events(spark, sf):
    rows = A.events(_archives(spark, sf))
    return rows.select("id", "archivo", "titulo", F.date_format("day", "yyyy-MM-dd").alias("day"), F.trim("municipio").alias("municipio"), "score", F.expr("try_variant_get(item, '$.mas.precio', 'double') IS NOT NULL").alias("mas"))


@query(f"WITH {_ITEMS} SELECT archivo, motivo, count(*) AS n FROM it WHERE motivo IS NOT NULL AND c % 13 > 0 GROUP BY ALL UNION ALL SELECT DISTINCT archivo, motivo, 1 FROM it WHERE c % 13 = 0")
def archive_aside(spark, sf):
    return A.aside(_archives(spark, sf))


@query(f"WITH {_ITEMS}, m AS (SELECT municipio, strftime(day, '%m') AS mes, count(*) AS n FROM it WHERE motivo IS NULL GROUP BY 1, 2) SELECT municipio, CAST(sum(n) OVER (PARTITION BY municipio) AS BIGINT) AS total, mes, n, n >= greatest(2, 0.085 * sum(n) OVER (PARTITION BY municipio)) AS caliente FROM m")
def archive_calendar(spark, sf):
    return A.calendar(A.events(_archives(spark, sf)), share=0.085)


# ---------------------------------------------------------------------- names
_WORD = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"
_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+')) AS w FROM documents)"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w"))


@query(f"WITH {_WORDS}, r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w COLLATE es, w) AS i FROM (SELECT DISTINCT doc_id, w FROM w)) SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS orden FROM r GROUP BY 1")
def words_in_order(spark, sf):
    """Each document's words, once, in Spanish order."""
    # a text's words are told apart in its row, and meet those of rows of one id
    once = read(spark, sf, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("x")).where(F.size("x") > 0)
    told = once.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("x"))
    order = F.array_sort(F.transform("x", lambda w: F.struct(O.in_order(w).alias("o"), w.alias("w"))))
    return told.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.transform(order, lambda x: x["w"]), " ")).alias("orden"))


@query(f"WITH {_WORDS}, c AS (SELECT w, count(*) AS n FROM w GROUP BY 1), r AS (SELECT *, replace(strip_accents(replace(lower(w), 'ñ', '~')), '~', 'ñ') AS k, row_number() OVER (PARTITION BY replace(strip_accents(replace(lower(w), 'ñ', '~')), '~', 'ñ') ORDER BY n DESC, w COLLATE es, w) AS i, CAST(sum(n) OVER (PARTITION BY k) AS BIGINT) AS total FROM c) SELECT w AS nombre, total AS n FROM r WHERE i = 1")
def names_one_spelling(spark, sf):
    return O.one_spelling(_words(spark, sf).select(F.col("w").alias("nombre")), "nombre")


# ---------------------------------------------------------------------- state
@query(f"WITH {EV} SELECT concat_ws(',', CASE WHEN grouping(municipio) = 0 THEN 'municipio' END, CASE WHEN grouping(fuente) = 0 THEN 'fuente' END) AS nivel, municipio, fuente, count(*) AS n, count(*) FILTER (hora = '') AS sin_hora FROM ev GROUP BY GROUPING SETS ((municipio, fuente), (municipio), (fuente), ())")
def state_totals(spark, sf):
    return U.totals(ev(spark, sf), [["municipio", "fuente"], ["municipio"], ["fuente"], []], sin_hora=F.col("hora") == "")


@query("SELECT user_id, event_type IN ('view', 'error') AND coalesce(value, 0) < 100 AS pendiente, count(*) AS n FROM events GROUP BY ALL")
def state_pending(spark, sf):
    kind = F.when(F.col("event_type") == "view", "programa-pdf").when(F.col("event_type") == "error", "pdf-escaneado").otherwise("otro")
    waits = U.is_pending(kind, F.coalesce("value", F.lit(0.0)) >= 100)
    return read(spark, sf, "events").groupBy("user_id", waits.alias("pendiente")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, s AS (SELECT DISTINCT o_orderpriority AS fuente FROM orders UNION SELECT DISTINCT fuente FROM ev) SELECT fuente, coalesce(n, 0) AS eventos, n IS NOT NULL AS ok FROM s LEFT JOIN (SELECT fuente, count(*) AS n FROM ev GROUP BY 1) USING (fuente)")
def state_sources(spark, sf):
    rows = ev(spark, sf)
    known = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("fuente")).union(rows.select("fuente")).distinct()
    return U.sources(rows, known)


@query("WITH b AS (SELECT DISTINCT 'k' || (o_custkey % 400) AS clave, o_orderkey % 3 AS part FROM orders), f AS (SELECT *, min(part) OVER (PARTITION BY clave) = part AS nueva FROM b) SELECT CAST(part AS BIGINT) AS lote, count(*) AS leidas, count(*) FILTER (nueva) AS nuevas FROM f GROUP BY 1")
def merge_counters(spark, sf):
    """What each of three batches read and made, as the writing jobs counted."""
    root, told = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", []
    for number, part in enumerate(stored_batches(spark, sf)):
        counts = M.apply_batch(spark, root, part, f"s{number}", "orders", number, "2026-01-01", number)
        told.append((number, counts["leidas"], counts["nuevas"]))
    return spark.createDataFrame(told, "lote long, leidas long, nuevas long").where("leidas > 0")


@query("WITH p AS (SELECT p_partkey AS id, p_brand AS orquesta, DATE '1994-06-01' + CAST(p_partkey % 40 AS INT) AS day FROM part), b AS (SELECT * FROM p WHERE day >= DATE '1994-06-20'), n AS (SELECT orquesta, count(*) AS n FROM b GROUP BY 1), s AS (SELECT l_orderkey, l_linenumber, p_brand AS orquesta, l_linenumber % 3 > 0 AS cancela FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, l_linenumber, coalesce(n, 0) AS casos, CASE WHEN n IS NULL THEN 'nuevo' WHEN NOT cancela THEN 'retoma' WHEN n = 1 THEN 'cancela' ELSE 'ambiguo' END AS accion FROM s LEFT JOIN n USING (orquesta)")
def signal_actions(spark, sf):
    part = read(spark, sf, "part")
    shows = part.select(F.col("p_partkey").alias("id"), F.date_add(F.lit("1994-06-01").cast("date"), (F.col("p_partkey") % 40).cast("int")).alias("day"), F.array("p_brand").alias("orquestas"))
    found = read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("orquesta"), (F.col("l_linenumber") % 3 > 0).alias("cancela"))
    return C.dispatched(found, C.bills(shows, "1994-06-20")).select("l_orderkey", "l_linenumber", "casos", "accion")


@query("SELECT event_id AS id, row_number() OVER (ORDER BY round(value) DESC NULLS LAST, user_id % 40, event_id) AS puesto FROM events")
def candidate_ranks(spark, sf):
    """All candidates numbered in one order, without a task that holds them all."""
    return X.ranked(read(spark, sf, "events").select(F.col("event_id").alias("id"), F.round("value").alias("score"), (F.col("user_id") % 40).alias("dias"))).select("id", "puesto")
