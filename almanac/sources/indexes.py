"""Indexes of landed pages as rows: titled links, paged monthly archives, cards,
searches in order, literal agendas, and the year that a page is of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import text as T

_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
_FILES = r"(?i)\.(pdf|jpg|jpeg|png|webp)$"
AGENDA = "titulo string, day string, hora string, municipio string, lugar string, orquestas array<string>, url string"


def _line(html: Column) -> Column:
    return F.trim(F.regexp_replace(T.html_lines(html), r"\s+", " "))


def _links(pages: DataFrame, base: str, *keys: str) -> DataFrame:
    """(keys, ord, url, titulo) of each link, its address made absolute."""
    found = pages.select(*keys, F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))).alias("ord", "_a"))
    href = F.trim(T.entities(F.regexp_extract("_a", _LINK, 1)))
    inside = F.regexp_replace("_a", "(?is)^<a[^>]*>|</a>$", "")
    url = F.when(href.startswith("/") & ~href.startswith("//"), F.concat(F.lit(base), href)).otherwise(href)
    return found.select(*keys, "ord", url.alias("url"), _line(inside).alias("titulo"))


def anchors(pages: DataFrame, base: str, keep: Callable[[Column], Column] | None = None, shortest: int = 15, most: int | None = None) -> DataFrame:
    """(url, titulo) of the links inside base on pages (pag, html), but files:
    titles of shortest characters or more that keep lets through; the first
    title of an address, by page and place, counts. most is a top-k: the first
    so many addresses."""
    rows = _links(pages, base, "pag").where(
        F.col("url").startswith(f"{base}/") & (F.col("url") != f"{base}/") & ~F.split("url", r"\?")[0].rlike(_FILES) & (F.char_length("titulo") >= shortest)
    )
    at = F.struct("pag", "ord", "titulo")
    first = (rows.where(keep(F.col("titulo"))) if keep else rows).groupBy("url").agg(F.min(at).alias("_at"))
    if most is not None:
        first = first.orderBy("_at", "url").limit(most)
    return first.select("url", "_at.titulo")


def month_archives(pages: DataFrame, base: str, most_pages: int = 6, enough: int = 40) -> DataFrame:
    """(anyo, mes, url, titulo) of the articles that monthly archives list, from
    pages (anyo, mes, pag, html). An archive is read from its page 1 on, up to
    most_pages, and ends before a page that is missing, at one without a new
    article, and after the one with which enough are found."""
    group = ["anyo", "mes"]
    rows = _links(pages, base, *group, "pag").withColumn("titulo", F.trim(F.regexp_replace("titulo", r"\s+20\d{2}\s*$", "")))
    inside = F.col("url").startswith(F.concat(F.lit(f"{base}/"), F.col("anyo").cast("string"), F.lit("/"))) & F.col("url").endswith(".html")
    first = rows.where(inside & (F.char_length("titulo") >= 15)).groupBy(*group, "url").agg(F.min(F.struct("pag", "ord", "titulo")).alias("_at"))
    links = first.select(*group, "url", "_at.pag", "_at.titulo")
    new = links.groupBy(*group, "pag").agg(F.count("*").alias("_new"))
    held = pages.select(*group, "pag").distinct().where(F.col("pag").between(1, most_pages)).join(new, [*group, "pag"], "left").fillna(0, ["_new"])
    w = Window.partitionBy(*group).orderBy("pag")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = held.select(*group, "pag", F.row_number().over(w).alias("_n"), F.min("_new").over(before).alias("_least"), F.sum("_new").over(before).alias("_sum"))
    told = seen.where((F.col("_n") == F.col("pag")) & (F.coalesce("_least", F.lit(1)) > 0) & (F.coalesce("_sum", F.lit(0)) < enough))
    return links.join(told.select(*group, "pag"), [*group, "pag"], "left_semi").select(*group, "url", "titulo")


def cards(pages: DataFrame, base: str, card: str = "small-post", inside: str = "/programacion/") -> DataFrame:
    """(url, titulo, categoria, dia, lugar, lugar_url) of the cards of an index,
    pages (pag, html): elements of class card with a titled link. The first card
    of an address counts."""
    parts = F.slice(F.split("html", rf'(?i)<[a-z0-9]+[^>]*class="(?:[^"]*\s)?{card}(?:\s[^"]*)?"[^>]*>', -1), 2, 100_000_000)
    cut = pages.select("pag", F.posexplode(parts).alias("ord", "_c"))
    title, told = r'(?is)<h4[^>]*class="[^"]*\btitle\b[^"]*"[^>]*>\s*<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', r'(?is)<a\b[^>]*\bhref="([^"]*/{}/[^"]*)"[^>]*>(.*?)</a>'
    kind, place = told.replace("{}", "categoria"), told.replace("{}", "lugares")
    fields = {
        "titulo": _line(F.regexp_extract("_c", title, 2)),
        "categoria": F.lower(_line(F.regexp_extract("_c", kind, 2))),
        "dia": _line(F.regexp_extract("_c", r'(?is)class="[^"]*\bpost-date\b[^"]*"[^>]*>(.*?)</', 1)),
        "lugar": _line(F.regexp_extract("_c", place, 2)),
        "lugar_url": F.regexp_extract("_c", place, 1),
    }
    rows = cut.select("pag", "ord", F.regexp_extract("_c", title, 1).alias("_h"), *[v.alias(n) for n, v in fields.items()])
    good = rows.where(F.col("_h").startswith(inside) & (F.col("titulo") != ""))
    first = good.groupBy("_h").agg(F.min_by(F.struct(*fields), F.struct("pag", "ord")).alias("_f"))
    return first.select(F.concat(F.lit(base), "_h").alias("url"), *[f"_f.{n}" for n in fields])


def in_order(searches: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """The first most rows (a top-k) of several searches of the same columns, by
    search and then by order; a key that an earlier one has is not repeated."""
    told = [s.withColumn("_search", F.lit(i)) for i, s in enumerate(searches)]
    rows = reduce(DataFrame.unionByName, told)
    w = Window.partitionBy(key).orderBy("_search", order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.orderBy("_search", order, key).limit(most).drop("_search", "_n")


def literal(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Events that somebody typed in, as a table; a row per (day, place, title)."""
    return spark.createDataFrame(rows, AGENDA).dropDuplicates(["day", "lugar", "titulo"])


def year_of(url: Column, html: Column, now: Column) -> Column:
    """The year of a page: the one in its address, else of its publication (its
    meta data, its notice, a written date, a time element), else now's."""
    found = [
        F.regexp_extract(url, r"(20\d{2})", 1),
        F.regexp_extract(html, r'article:published_time"\s+content="(20\d{2})', 1),
        F.regexp_extract(html, r"(?is)fecha de publicaci[oó]n.{0,400}?(20\d{2})", 1),
        F.regexp_extract(html, r"(?i)\b\d{1,2}\s+(?:de\s+)?[a-záéíóúñ]+(?:\s+de|,)?\s+(20\d{2})", 1),
        F.regexp_extract(html, r'datetime="(20\d{2})-\d{2}-\d{2}', 1),
    ]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], now.cast("string"))


def chip_year(chip: Column, text: Column, now: Column) -> Column:
    """The year of a date chip ("Sáb, 12/09/26") or one in the text after it,
    else a year that the text names, else now's."""
    short = F.regexp_extract(F.concat_ws(" ", chip, text), r"\d{1,2}/\d{1,2}/(\d{2,4})", 1)
    full = F.when(F.char_length(short) == 2, F.concat(F.lit("20"), short)).otherwise(short)
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(F.regexp_extract(text, r"\b(20[2-9]\d)\b", 1), F.lit("")), now.cast("string"))
