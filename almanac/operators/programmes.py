"""Programme texts as dated sections, and the performers that a title names.

Sections are rows: a text is cut at whatever looks like a day's header, what the
calendar or a deadline speaks against is joined to the section before it, and a
running count of headers numbers the sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions.text import MARKED, PLAIN, fold
from almanac.operators.spans import cut

_FOLD = str.maketrans(MARKED, PLAIN)
#: Weekdays and months as written, words before a date that make
#: it a deadline, and what leads to the next day's first act.
WEEK = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo"
MONTH = "|".join([*D.MONTHS, "setiembre"])
DEADLINE = "hasta|antes|desde|plazo|inscripci[oó]n|cierra|cierre"
CONNECTOR = r"a\s+su\s+t[eé]rmino"

_S = r"[^\S\n]"
_DAY = r"(?<!\d)\d{1,2}(?!\d|[:.]\d\d(?!\d))"
_END = r"(?!\p{L})"
_MONTH_YEAR = rf"{_S}+(?:de{_S}+)?(?:{MONTH}){_END}(?:{_S}+(?:de{_S}+)?20\d\d(?!\d))?"
#: The four kinds of headers: "viernes 11 [de septiembre [de 2026]]"; "el [día]
#: 25 de abril", unless a limit; "18 viernes", of which only the number is taken;
#: "7 [- 9] de agosto" at the start of a line.
_NAMED = rf"(?<!\p{{L}})(?:{WEEK}){_END}{_S}*,?{_S}*{_DAY}(?:{_MONTH_YEAR})?"
_OF = r"(?:(?:de|del|el)[\s:,]{1,3})?"
_THE = rf"(?=el{_S})(?<!(?:{DEADLINE})[\s:,]{{1,3}}{_OF}{_OF})(?<!\p{{L}})el{_S}+(?:d[ií]a{_S}+)?{_DAY}{_MONTH_YEAR}"
_FIRST = rf"{_DAY}(?={_S}+(?:{WEEK}){_END})"
_LINE = rf"(?<=^[ \t]{{0,8}}){_DAY}(?:{_S}*[-–]{_S}*{_DAY})?{_S}+de{_S}+(?:{MONTH}){_END}(?!{_S}*\p{{L}})"
_LEAD = rf"(?:(?=a)(?<=^|[.\n][ \t]{{0,3}}){CONNECTOR}{_END}[^.\n]{{0,300}}?[.\n]?{_S}*)?"
#: Each begins at a word that one of them begins with; few places get further, as
#: what is slow, looking back, comes after the letters that a part begins with.
_BEGINS = rf"(?=[lmjvsdea\d])(?<![\p{{L}}\d])(?=\d|lu|ma|mi|ju|vi|s[aá]|do|el{_S}|a\s)"
HEADER = rf"(?ium){_BEGINS}{_LEAD}(?:(?=[lmjvsd]){_NAMED}|{_THE}|(?=\d)(?:{_FIRST}|{_LINE}))"


def sections(programmes: DataFrame, key: str, text: str, mes: Column | None = None, anyo: Column | None = None) -> DataFrame:
    """One row for each dated section: the key, its ordinal, where it begins,
    day, month and year ('' where the header has none), and its text. A header of
    number and weekday has to agree with the calendar where month and year of the
    text are known (mes, anyo). What follows "a su término" in the sentence just
    before a header belongs to that day. key names one text. Reading a text takes
    far longer than its bytes let Spark expect, so that texts are dealt to some
    tasks for each core and these are not joined by size."""
    spark = programmes.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    told = programmes.select(key, F.col(text).alias("_t"), (F.lit("") if mes is None else F.coalesce(mes, F.lit(""))).alias("_mes"), (F.lit("") if anyo is None else F.coalesce(anyo, F.lit(""))).alias("_anyo")).repartition(tasks, key)
    rows = cut(told, [key, "_mes", "_anyo"], F.col("_t"), HEADER)
    w = Window.partitionBy(key).orderBy("i")
    leads = F.col("hit").rlike(rf"(?iu)^{CONNECTOR}")
    rows = rows.withColumn("_head", F.when(leads, F.regexp_replace("hit", rf"(?ius)^{CONNECTOR}\b.*?(?=(?:{_NAMED}|{_THE}|{_DAY})$)", "")).otherwise(F.col("hit")))
    head = F.col("_head")
    # a cast that fails costs more than all else, so that nothing is cast where no day is told
    day = F.nullif(F.regexp_extract(head, _DAY, 0), F.lit("")).try_cast("int")
    month = D.month_number(F.regexp_extract(fold(head), rf"\b({MONTH})\b", 1))
    year = F.regexp_extract(head, r"\b(20\d\d)\b", 1)
    bare = head.rlike(r"^\d+$")
    after = F.concat("piece", F.coalesce(F.lead("hit").over(w), F.lit("")))
    weekday = F.regexp_extract(fold(after), rf"^\s+({'|'.join(D.WEEKDAYS)})", 1)
    date = D.as_date(F.concat_ws("-", F.lpad(day.cast("string"), 2, "0"), "_mes", "_anyo"))
    agrees = (F.col("_mes") == "") | (F.col("_anyo") == "") | F.coalesce(D.weekday_name(date) == weekday, F.lit(False))
    seen = rows.withColumns({"_d": day, "_m": month, "_y": year, "_bare": bare, "_agrees": agrees}).withColumn("_ok", (F.col("i") > 0) & F.coalesce(F.col("_d").between(1, 31), F.lit(False)) & (~F.col("_bare") | F.col("_agrees")))
    # a weekday right after a number that was a header is that header's
    taken = F.coalesce(F.lag(F.col("_bare") & F.col("_ok") & (F.trim("piece") == "")).over(w), F.lit(False))
    seen = seen.withColumn("_ok", F.col("_ok") & ~taken).withColumn("ord", F.sum(F.col("_ok").cast("int")).over(w) - 1)
    line = F.struct("i", F.concat("hit", "piece").alias("t"))
    first = lambda c: F.min_by(c, "i")
    return seen.where("ord >= 0").groupBy(key, F.col("ord").cast("int").alias("ord")).agg(
        first("pos").alias("pos"), first("_d").alias("dia"), first("_m").alias("mes"), first("_y").alias("anyo"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "").alias("texto")
    )


#: Kinds of performers, articles, words after which "con", "por"
#: or "de" names performers, venues, what is handed out, and how clauses begin.
KINDS = set("orquesta orquestas grupo grupos parranda parrandas tributo banda bandas duo dj".split())
ARTICLES = set("el la los las".split())
TRIGGERS = {"con": set("verbena verbenas baile bailes concierto noche musica".split()), "por": set("amenizado amenizada amenizados amenizadas animado animada animados animadas".split()), "de": set("actuacion actuaciones cargo".split())}
VENUES = set("plaza plazoleta parque cancha calle teatro iglesia avenida polideportivo recinto campo pabellon auditorio ermita parroquia tenerife canarias canaria".split())
HANDED = set("entrega premio premios nombramiento comision sorteo rifa descanso trofeo homenaje fuego fuegos pirotecnia".split())
CLAUSES = set("que para porque donde cuando como sin a de desde".split())
NAME_TOKEN = re.compile(r"[^\W_][\w'’&+-]*|[,;:.·•()]", re.U)


def folded(text: str) -> str:
    """Lower case without marks, of the same length."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # a final sigma depends on its word
        return low.translate(_FOLD)
    return "".join(c if len(c) == 1 else " " for c in map(str.lower, text)).translate(_FOLD)


def names_of(title: str | None) -> list[str]:
    """The performers that a title names, in order, each once whatever marks.

    The words are read from left to right. A kind ("Orquesta ...") or a trigger
    ("verbena con ...") opens a list, a full stop, semicolon or bracket closes
    it. In a list commas and bullets part names; "y" parts them in a list after
    a trigger or a plural, else only before another kind, as it is part of many
    names. After a kind in the singular only names with a kind of their own
    follow. A name has a capital, and is no venue, clause or thing handed out."""
    low = folded(title or "")
    words = [(m[0], low[m.start() : m.end()], m.start(), m.end()) for m in NAME_TOKEN.finditer(title or "")]
    word = lambda i: words[i][1] if 0 <= i < len(words) else ""
    found: list[str] = []

    def kind_ahead(i: int) -> bool:
        return word(i) in KINDS or (word(i) in ARTICLES and word(i + 1) in KINDS)

    def take(first: int, last: int, needs_kind: bool) -> None:
        has_kind = any(word(i) in KINDS for i in range(first, last))
        while first < last and (word(first) in KINDS or word(first) in ARTICLES or word(first) == ":" or word(first)[:1].isdigit()):
            first += 1
        inner = {word(i) for i in range(first, last)}
        if first >= last or (needs_kind and not has_kind) or inner & HANDED or word(first) in CLAUSES or (inner & VENUES and not has_kind):
            return
        name = title[words[first][2] : words[last - 1][3]]
        if len(name) > 2 and any(c.isupper() for c in name) and not any(folded(f) in folded(name) or folded(name) in folded(f) for f in found):
            found.append(name)

    i = 0
    while i < len(words):
        plural = word(i) in ("orquestas", "grupos", "bandas", "parrandas")
        own = word(i) in KINDS
        told = word(i - 1) in TRIGGERS.get(word(i), ()) or (word(i) == "con" and (kind_ahead(i + 1) or words[min(i + 1, len(words) - 1)][0][:1].isupper()))
        if not own and not told:
            i += 1
            continue
        start, several, first = (i if own else i + 1), told or plural, True
        i = start + own
        while True:
            w = word(i)
            closes = w in ("", ".", ";", "(", ")") or (w in ("en", "a") and word(i + 1) in ARTICLES)
            joins = w in (",", "·", "•") or (w == "y" and (several or kind_ahead(i + 1))) or w == "ademas"
            if closes or joins:
                take(start, i, not first and not several)
                first = False
                start = i + 1 + (w == "ademas" and word(i + 1) == "de")
            if closes:
                break
            i += 1
        i += 1
    return found


def line_up(title: Column) -> Column:
    """names_of as a Column, in Arrow batches."""

    def names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for titles in batches:
            yield titles.map(names_of)

    return F.pandas_udf(names, "array<string>")(title)
