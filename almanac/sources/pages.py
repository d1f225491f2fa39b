"""Landed pages as rows: tables below month headings, public posts, calendar
days, sheets with hours and days, and lists in a model's answer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.session import ship

_MONTHS = "|".join([*D.MONTHS, "setiembre"])


def agenda_tables(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, ord, mes, anyo, fecha, localidad, tipo, orquestas) of table rows
    with four cells or more, but headers; the last heading or paragraph with
    month and year before a row gives both, '' without."""
    block = r"(?is)<(h[1-4]|p|tr)\b[^>]*>(.*?)</\1>"
    parts = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("ord", "b"))
    row, head = F.lower("b").startswith("<tr"), rf"\b({_MONTHS})\s+(?:de\s+)?(20\d{{2}})\b"
    cells = F.transform(F.regexp_extract_all("b", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.replace(T.html_lines(c), F.lit("\n"), F.lit(" ")))
    text = T.fold(T.html_lines(F.col("b")))
    told = F.when(~row & text.rlike(head), F.struct(D.month_number(F.regexp_extract(text, head, 1)).alias("mes"), F.regexp_extract(text, head, 2).alias("anyo")))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.select(key, "ord", row.alias("_row"), F.when(row, cells).alias("c"), F.last(told, True).over(w).alias("_h"))
    data = seen.where(F.col("_row") & (F.size("c") >= 4) & ~T.fold(F.col("c")[0]).startswith("fecha"))
    state = lambda f: F.coalesce(F.col(f"_h.{f}"), F.lit("")).alias(f)
    return data.select(key, "ord", state("mes"), state("anyo"), *[F.col("c")[i].alias(n) for i, n in enumerate(("fecha", "localidad", "tipo", "orquestas"))])


def public_posts(pages: DataFrame) -> DataFrame:
    """(id, url, texto, canonica, handle) of pages (url, html) of public posts:
    the description, the number in the address or the canonical one, else a
    hash of the address. Pages without a description are none."""
    told = lambda p: T.entities(F.regexp_extract("html", p, 1))
    text, canonical = told(r'(?s)<meta name="description" content="(.*?)"\s*/?>'), told(r'<link rel="canonical" href="(.*?)"')
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"fbid=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(canonical, r"/(\d+)/?$", 1), F.lit("")), F.substring(F.sha1("url"), 1, 12))
    rows = pages.select(F.concat(F.lit("post-"), number).alias("id"), "url", F.trim(text).alias("texto"), canonical.alias("canonica"))
    handle = T.handle(F.coalesce(F.nullif("canonica", F.lit("")), "url"))
    return rows.where("texto <> ''").withColumn("handle", handle)


def upcoming(events: DataFrame, today: str, days: int = 60, start: str = "start") -> DataFrame:
    """Calendar events (start: ISO) from today to so many days on, with day and
    hora ('' for a whole day)."""
    at = F.try_to_date(F.substring(start, 1, 10), "yyyy-MM-dd")
    first = F.lit(today).cast("date")
    return events.where(at.between(first, F.date_add(first, days))).select("*", D.day_text(at).alias("day"), F.regexp_extract(start, r"[T ](\d{2}:\d{2})", 1).alias("hora"))


def sheet_hour(text: Column) -> Column:
    """The hour of a sheet ("@ 9:00 am", "11:30 pm") as HH:mm, '' without."""
    p = r"(?i)(\d{1,2}):(\d{2})\s*([ap])\.?m"
    hour = F.regexp_extract(text, p, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(text, p, 3)) == "p", 12).otherwise(0)
    return F.coalesce(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(text, p, 2)), F.lit(""))


def title_days(title: Column, year: Column) -> Column:
    """The days that a title lists ("25 y 26 de abril y 1 de mayo"), in order,
    as dd-MM-yyyy; what is no date is left out."""
    group = rf"((?:\d{{1,2}}\s*(?:,|y)\s*)*\d{{1,2}})\s+de\s+({_MONTHS})\b"
    t = T.fold(title)
    groups = F.regexp_extract_all(t, F.lit(group), F.lit(0))

    def days(g: Column) -> Column:
        month = D.month_number(F.regexp_extract(g, group, 2))
        return F.transform(F.regexp_extract_all(g, F.lit(r"\d{1,2}"), F.lit(0)), lambda d: D.day_text(D.as_date(F.concat_ws("-", F.lpad(d, 2, "0"), month, year.cast("string")))))

    return F.filter(F.flatten(F.transform(groups, days)), lambda d: d.isNotNull())


_LIST = re.compile(r"\[\s*\{")


def longest_list(answer: str | None, needed: str) -> str | None:
    """The longest JSON list of objects with a numeric field in a text. Only a
    bracket before a brace can begin one, and a list that was read is not looked
    into again; the decoder gives up a false start where its syntax breaks, and all
    of them together are read for fifty times the text at most."""
    text, best, end, decoder = answer or "", "", 0, json.JSONDecoder()
    left = 50 * len(text)  # characters that false starts may be read for
    for start in _LIST.finditer(text):
        if start.start() < end:
            continue
        try:
            value, stop = decoder.raw_decode(text, start.start())
        except json.JSONDecodeError as e:
            left -= e.pos - start.start()
            if left < 0:
                break
            continue
        except RecursionError:
            break
        end = stop
        if stop - start.start() > len(best) and all(isinstance(v, dict) and isinstance(v.get(needed), int | float) for v in value):
            best = text[start.start() : stop]
    return best or None


def answers(texts: DataFrame, key: str, text: str, schema: str, needed: str = "indice") -> DataFrame:
    """Rows of the list in each answer of a model, by schema (a struct's DDL);
    prose around it, other lists and answers without one give nothing."""
    ship(texts.sparkSession)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: longest_list(t, needed))

    found = texts.select(key, F.pandas_udf(read, "string")(F.col(text)).alias("_j")).where("_j IS NOT NULL")
    return found.select(key, F.inline(F.from_json("_j", f"array<struct<{schema}>>")))
