"""One plan for all sources of pages: landed html to accepted events.

What makes a source different is not code but a row of a table of knobs, which is
joined to the pages of all sources at once: how the year of a page is known, which
month a day without one is of, how its text is cut, which titles earn points, and
in which order venues are looked for. A new source is a new row.

Pages lie in folders by source, so that a filter on the source keeps the others'
files closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import acts as A
from almanac.operators import layout as L
from almanac.operators import matching as M
from almanac.operators import places as P
from almanac.operators import social
from almanac.operators.scoring import scored
from almanac.session import materialize, sized
from almanac.sources import pages as G

#: The knobs of a source; null stands for the first of each kind of rule.
#: regla_anyo: "ruta" (a year in the address), "publicado" (the page's stated time
#: of publication, else a visible date), "fijo" (anyo_fijo). regla_mes of days without
#: a month: "contexto" (a month that a year follows, else the one named most),
#: "turno" (mes_antes from day `turno` on, else mes_despues), "seccion" (no other).
#: partir: "dias" (day headers), "lugar" (venue bullets, each cut by day headers),
#: "ficha" (a sheet: days of the title, hour of the text). patron_extra, puntos_extra:
#: points for titles that match and name music. cascada: where a venue is looked
#: for, in order: linea, titulo, continuacion, campo, nucleo, defecto.
KNOBS = "fuente string, municipio string, regla_anyo string, anyo_fijo string, regla_mes string, turno int, mes_antes string, mes_despues string, partir string, articulo boolean, patron_extra string, puntos_extra int, nucleos array<string>, cascada array<string>, etiqueta string"
CASCADE = ["campo", "linea", "continuacion", "titulo", "nucleo", "defecto"]
EVENT = ["id", "titulo", "day", "hora", "municipio", "lugar", "orquestas", "tipo", "url", "score", "motivos", "fuente"]
MUSIC = r"orquesta|grupo|banda|\bdj\b|parranda|tributo"


def landed(spark: SparkSession, base: str, sources: list[str] | None = None) -> DataFrame:
    """(url, html, fuente) of pages landed as JSON lines in base/fuente=.../;
    with sources only their folders are opened."""
    rows = spark.read.schema("url string, html string, fuente string").option("basePath", base).json(base)
    return rows if sources is None else rows.where(F.col("fuente").isin(sources))


def knobs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of knobs; what a row leaves out is null."""
    names = [c.split()[0] for c in KNOBS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], KNOBS)


def known_pages(pages: DataFrame, table: DataFrame, this_year: int) -> DataFrame:
    """Pages with their source's knobs, _key, limpio (their text), anyo and mes of
    the whole page ('' without). Pages of sources without knobs, and of a year
    that is over or not known, are left out."""
    p = pages.join(sized(table), "fuente")
    html = F.coalesce("html", F.lit(""))
    body = F.when(F.coalesce("articulo", F.lit(False)), L.article_body(html)).otherwise(T.html_lines(html))
    p = p.withColumn("limpio", T.rewritten(T.hours(body), T.PROGRAMME))
    told = F.regexp_extract("url", r"(20\d\d)", 1)
    published = F.coalesce(F.nullif(F.regexp_extract(html, r'article:published_time"\s+content="(20\d\d)', 1), F.lit("")), F.regexp_extract(html, r'datetime="(20\d\d)-\d\d-\d\d', 1))
    visible = F.regexp_extract(T.fold(F.col("limpio")), rf"\b\d{{1,2}}\s+(?:de\s+)?(?:{'|'.join(D.MONTHS)})(?:\s+de|,)?\s+(20\d\d)\b", 1)
    rule = F.coalesce("regla_anyo", F.lit("ruta"))
    context = D.month_context(F.col("limpio"))
    year = F.when(rule == "fijo", F.col("anyo_fijo")).when(rule == "publicado", F.coalesce(F.nullif(published, F.lit("")), visible)).otherwise(told)
    p = p.withColumn("anyo", F.coalesce(year, F.lit(""))).where((F.col("anyo") != "") & (F.col("anyo") >= str(this_year)))
    own = F.when(F.coalesce("regla_mes", F.lit("contexto")) == "contexto", F.coalesce(F.nullif(context["mes"], F.lit("")), M.most_named_month(F.col("limpio")))).otherwise("")
    return p.withColumn("mes", own).withColumn("_key", F.sha1(F.concat_ws("|", "fuente", "url", "limpio"))).dropDuplicates(["_key"])


def sections(pages: DataFrame) -> DataFrame:
    """(_key, ord, day, texto, _lugar): the dated sections of known pages that
    are cut by days or by venues; days that cannot be told are left out."""
    parts = F.when(F.coalesce("partir", F.lit("dias")) == "lugar", F.col("limpio")).otherwise("")
    split = L.by_place(pages.select("_key", "fuente", "mes", "anyo", "partir", "limpio", parts.alias("texto")))
    by_venue = F.col("partir") == "lugar"
    whole = split.withColumn("texto", F.when(by_venue, F.col("texto")).otherwise(L.hour_with_act(F.col("limpio")))).withColumn("_part", F.concat_ws("|", "_key", "parte"))
    found = A.inherited(whole, "_part", "texto", F.col("mes"), F.col("anyo"))
    of = pages.select("_key", F.col("mes").alias("_mes"), F.col("anyo").alias("_anyo"), "regla_mes", "turno", "mes_antes", "mes_despues")
    met = found.join(whole.select("_part", "_key", F.when(by_venue, F.col("lugar")).otherwise("").alias("_lugar"), "parte"), "_part").join(of, "_key")
    turned = F.when(F.col("regla_mes") == "turno", L.month_by_day(F.col("dia"), F.col("turno"), F.col("mes_antes"), F.col("mes_despues")))
    month = F.coalesce("mes", F.nullif("_mes", F.lit("")), turned)
    day = A.day_of(F.col("dia"), month, F.coalesce("anyo", "_anyo"))
    # sections of all parts of a page count on, so that an hour may carry over
    order = Window.partitionBy("_key").orderBy("parte", "ord")
    return met.withColumn("day", day).withColumn("ord", F.row_number().over(order).cast("int") - 1).where("day <> ''").select("_key", "ord", "day", "texto", "_lugar")


def sheets(pages: DataFrame) -> DataFrame:
    """(_key, ord, day, texto, _lugar) of pages that are a sheet of one act: a
    row for each day that the title, the first line, or else the text lists."""
    first = F.split("limpio", "\n")[0]
    listed = G.title_days(first, F.col("anyo"))
    days = F.when(F.size(listed) > 0, listed).otherwise(G.title_days(F.col("limpio"), F.col("anyo")))
    timed = F.concat(F.coalesce(F.nullif(G.sheet_hour(F.col("limpio")), F.lit("")), F.regexp_extract("limpio", r"\b(\d{1,2}:\d{2})", 1)), F.lit(" "), F.regexp_replace("limpio", r"(?i)(\d{1,2}:\d{2})(\s*[ap]\.?m\.?)?", ""))
    rows = pages.where("partir = 'ficha'").select("_key", timed.alias("texto"), F.posexplode(F.array_distinct(days)).alias("ord", "day"))
    return rows.select("_key", "ord", "day", "texto", F.lit("").alias("_lugar"))


def cascade(order: Column, ways: dict[str, Column]) -> Column:
    """The first venue that is not empty, of ways in the order that a row tells."""
    table = F.create_map(*[x for name, way in ways.items() for x in (F.lit(name), F.coalesce(way, F.lit("")))])
    return F.coalesce(F.try_element_at(F.filter(F.transform(order, lambda n: F.try_element_at(table, n)), lambda v: v != ""), F.lit(1)), F.lit(""))


def events(pages: DataFrame, table: DataFrame, names: list[str] = (), this_year: int = 2026) -> DataFrame:
    """Accepted events (see EVENT) of landed pages (fuente, url, html), by the
    table of knobs; of several with one id the first in order of page, section and
    stretch stays. names: a dictionary of bounded size."""
    # both are read several times, and html is cleaned and cut once
    known = materialize(known_pages(pages, table, this_year).drop("html"), "known")
    cut = materialize(sections(known.where("partir IS NULL OR partir <> 'ficha'")).unionByName(sheets(known)), "cut")
    found = A.acts_of(cut.select("_key", "ord", "day", "texto"), "_key", names)
    held = found.join(cut.select("_key", "ord", "_lugar", "texto"), ["_key", "ord"]).join(known.select("_key", "fuente", "url", "municipio", "nucleos", "cascada", "patron_extra", "puntos_extra", "etiqueta"), "_key")

    title, low = F.col("titulo"), T.fold(F.col("titulo"))
    near = F.filter(F.coalesce("nucleos", F.array().cast("array<string>")), lambda n: F.contains(T.fold(F.col("texto")), T.fold(n)))
    ways = {
        "linea": F.col("lugar"), "campo": F.coalesce(F.nullif("_lugar", F.lit("")), P.place_told(F.col("texto"))), "titulo": P.place_in_title(title),
        "continuacion": P.place_continued(F.col("texto"), title), "nucleo": F.try_element_at(near, F.lit(1)), "defecto": F.col("municipio"),
    }
    place = cascade(F.coalesce("cascada", F.array(*map(F.lit, CASCADE))), ways)
    music = low.rlike(MUSIC)
    bonus = F.when(F.coalesce(F.regexp(low, T.fold(F.col("patron_extra"))), F.lit(False)) & music, F.col("puntos_extra")).otherwise(0)
    held = held.withColumn("lugar", place).withColumn("_extra", F.when(F.col("suelta") & ~music, 2).otherwise(0) + F.coalesce(bonus, F.lit(0)))
    rated = scored(held, social.event_rules(list(names), title, F.col("cerca"), F.col("hora"), F.col("lugar"), F.col("_extra"))).where("aceptado")

    last = F.regexp_extract(F.regexp_replace("url", r"/+$", ""), r"([^/]*)$", 1)
    words = F.array_join(F.slice(F.split(title, r"\s+"), 1, 3), " ")
    hour = F.coalesce(F.nullif(F.replace("hora", F.lit(":"), F.lit("")), F.lit("")), F.lit("sh"))
    own = F.regexp_replace(T.fold(F.concat_ws("-", "fuente", F.substring(last, 1, 20), hour, "day", words)), "[^a-z0-9-]+", "-")
    rows = rated.withColumn("id", own).withColumn("tipo", social.event_kind(title)).withColumn("motivos", F.when(F.col("etiqueta").isNull(), F.col("motivos")).otherwise(F.array_append("motivos", F.col("etiqueta"))))
    first = Window.partitionBy("id").orderBy("url", "ord", "n")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*EVENT)
