"""Acts of a programme: what is danced, at what hour, where, and who plays.

Sections come from programmes.sections; a section without month or year takes
the last one before it, else the first after it, by windows. A section is cut
into stretches, a sentence or line each, and anew at each time; hours and venues
are told by the stretches they stand in. An act takes its hour and venue from its
own stretch, else by an as-of join from the stretches around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions.text import fold, hours, words_only
from almanac.operators import places as P
from almanac.operators.programmes import line_up, sections
from almanac.operators.spans import first_after, last_before, parts, placed
from almanac.session import ship

#: Words of a dance, of what is none, of the past, of music.
DANCE = r"\b(gran baile|gran verbena|baile|verbenas?|verbenazo|megaverbena|tardeo|noche latina|noche boricua|noche en blanco|latinazo|romeria|concierto bailable|noche de kioscos|fiesta canaria)\b"
NOT_A_DANCE = r"escuela|taller|academia|clases? de|feria infantil|infantil|exposicion|torneo|campeonato|trofeo|carrera"
ONLY_A_LIST = r"^\W*(baile|bailes|musica)\s*,"
PAST = r"\b(fue|fueron|tuvo|hubo|han sido|disfruto|disfrutaron|se celebro|celebraron|congrego|congregaron|reunio|reunieron|acogio|asistieron)\b"
MUSIC = r"orquesta|verbena|baile|grupo|actuacion|concierto|ameniza|musica|\bdj\b"

_TIME = r"(?<!\d)(?:[01]?\d|2[0-3]):[0-5]\d(?!\d)"
_RANGE = rf"{_TIME}(?:\s*h(?:oras)?\b\.?)?(?:\s*(?:-|–|a(?:\s+las)?)\s*{_TIME})?"
_STOP = r"[.;\n]\s|\n"
#: A time that begins a stretch: not one that a phrase leads to ("a las 22:00").
_NEW = rf"(?<!\b(?:a|de|desde|hasta|sobre)\s{{1,2}}(?:las?\s{{1,2}})?){_RANGE}"
STRETCH = rf"(?isu)(?:{_RANGE})?(?:[^\d.;\n]|(?!{_NEW}|{_STOP}).)*+(?:[.;\n]\s+|\n)?"
#: Characters in which an hour or venue told before, or after, an act holds.
BEFORE, AFTER, TAIL = 400, 120, 600


def inherited(programmes: DataFrame, key: str, text: str, mes: Column | None = None, anyo: Column | None = None) -> DataFrame:
    """Sections (key, ord, pos, dia, mes, anyo, texto): month and year are carried
    forward, else taken from the next section that has one; null without."""
    s = sections(programmes, key, text, mes, anyo)
    w = Window.partitionBy(key).orderBy("ord")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    around = {c: F.coalesce(F.last(told(c), True).over(back), F.first(told(c), True).over(ahead)) for c in ("mes", "anyo")}
    return s.withColumns(around).select(key, "ord", "pos", "dia", "mes", "anyo", "texto")


def day_of(dia: Column, mes: Column, anyo: Column) -> Column:
    """dd-MM-yyyy where there is such a day, else ''."""
    date = F.try_to_date(F.concat_ws("-", F.lpad(dia.cast("string"), 2, "0"), mes, anyo), "dd-MM-yyyy")
    return F.coalesce(F.when(mes.isNotNull() & anyo.isNotNull(), D.day_text(date)), F.lit(""))


def dated(programmes: DataFrame, key: str, text: str, mes: Column | None = None, anyo: Column | None = None) -> DataFrame:
    """Sections (key, ord, pos, day, texto), with the day of their header."""
    s = inherited(programmes, key, text, mes, anyo)
    return s.select(key, "ord", "pos", day_of(F.col("dia"), F.col("mes"), F.col("anyo")).alias("day"), "texto")


def joined_lines(text: Column) -> Column:
    """Lines that a layout broke inside a phrase, and bullets, as one line."""
    t = F.regexp_replace(text, r"(?u)(\p{L})\n(\p{Ll})", "$1 $2")
    return F.regexp_replace(t, r"\n\s*[*•-]\s*", ", ")


def hour_of(time: Column) -> Column:
    """The start of a time or range as HH:mm."""
    return F.when(time != "", F.lpad(F.regexp_extract(time, r"(\d{1,2}:\d{2})", 1), 5, "0"))


def stretches(dated_sections: DataFrame, key: str) -> DataFrame:
    """(key, ord, n, day, piece, at, start): the stretches of each section, their
    place among all and where they and their section begin, with what they tell: hora,
    rango (an hour that is a range's), lugar (a venue) and campo ("Lugar: ...")."""
    rows = parts(dated_sections, [key, "ord", "day"], joined_lines(hours(F.col("texto"))), STRETCH)
    rows = placed(rows.withColumnRenamed("i", "n").drop("pos"), [key], F.char_length("piece"), "ord", "n").withColumnRenamed("pos", "at")
    start = F.first("at").over(Window.partitionBy(key, "ord").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    time = F.regexp_extract("piece", rf"(?iu){_RANGE}", 0)
    hour = hour_of(time)
    ranged = F.when(time.rlike(rf"{_TIME}.*{_TIME}"), hour)
    nothing = F.lit("")
    return rows.select(key, "ord", "n", "day", "piece", "at", start.alias("start"), hour.alias("hora"), ranged.alias("rango"), F.nullif(P.venue_in(F.col("piece")), nothing).alias("lugar"), F.nullif(P.place_told(F.col("piece")), nothing).alias("campo"))


def acts(programmes: DataFrame, key: str, text: str, names: list[str] = (), mes: Column | None = None, anyo: Column | None = None) -> DataFrame:
    """The acts of programmes (key, text); see acts_of."""
    found = acts_of(dated(programmes, key, text, mes, anyo), key, names)
    return found.select(key, "ord", "n", "day", "titulo", "hora", "lugar", "orquestas", "suelta")


def acts_of(dated_sections: DataFrame, key: str, names: list[str] = ()) -> DataFrame:
    """One row for each act of each dated section: key, ord, n (its stretch), day,
    titulo, hora, lugar, orquestas, suelta (its stretch has no time of its own) and
    cerca, what is told within 400 characters of it.
    A stretch is an act where it names a dance, or music with a performer of the
    dictionary (of bounded size), and nothing speaks against it. Its hour: its
    stretch's; else that of the last range, or else the last time, in the 400
    characters before it, of this section or the 600 last characters of the one
    before; else the next in the 120 after. Its venue: "Lugar: ...", its
    stretch's, the last of this section in the 400 characters before, the first in
    the 200 after. One act that is told twice is one."""
    ship(dated_sections.sparkSession)
    rows = stretches(dated_sections, key)
    # all but what is told nearby is read in one order, so that rows are sorted once
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct("at", "ord", F.col(c).alias("v")))
    seen = rows.withColumns({
        "_range": last_before(told("rango"), [key], "ord", "n", own=False), "_time": last_before(told("hora"), [key], "ord", "n", own=False), "_next": first_after(told("hora"), [key], "ord", "n"),
        "_venue": last_before(told("lugar"), [key], "ord", "n", own=False), "_beyond": first_after(told("lugar"), [key], "ord", "n"),
    })
    around = Window.partitionBy(key, "ord").orderBy("at").rangeBetween(-BEFORE, BEFORE)
    seen = seen.withColumn("cerca", F.array_join(F.collect_list("piece").over(around), ""))
    end = F.col("at") + F.char_length("piece")
    here = lambda c: F.col(f"{c}.ord") == F.col("ord")
    holds = lambda c: F.when(F.col(f"{c}.at") >= F.greatest(F.col("at") - BEFORE, F.col("start") - TAIL), F.col(f"{c}.v"))
    soon = F.when(here("_next") & (F.col("_next.at") <= end + AFTER), F.col("_next.v"))
    # of several times the last before the dance is the act's, else the first
    seen = seen.withColumn("_low", fold(F.col("piece"))).withColumn("_dance", F.regexp_instr("_low", F.lit(DANCE)))
    low, dance = F.col("_low"), F.col("_dance")
    told_before = F.regexp_extract_all(F.substring("piece", F.lit(1), dance - 1), F.lit(rf"(?iu){_RANGE}"), F.lit(0))
    own = F.coalesce(hour_of(F.try_element_at(told_before, F.lit(-1))), F.col("hora"))
    hour = F.coalesce(own, holds("_range"), holds("_time"), soon, F.lit(""))
    before = F.when(here("_venue") & (F.col("_venue.at") >= F.col("at") - P.BEFORE), F.col("_venue.v"))
    beyond = F.when(here("_beyond") & (F.col("_beyond.at") <= end + P.AFTER), F.col("_beyond.v"))
    place = F.coalesce("campo", "lugar", before, beyond, F.lit(""))

    spaced = F.concat(F.lit(" "), words_only(F.col("piece")), F.lit(" "))
    known = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: F.contains(spaced, F.concat(F.lit(" "), words_only(n), F.lit(" "))))
    # what few stretches have is asked first
    good = ((dance > 0) | ((F.size(known) > 0) & low.rlike(MUSIC)) if names else dance > 0) & (F.char_length(F.trim("piece")) >= 6) & ~low.rlike(ONLY_A_LIST) & ~low.rlike(NOT_A_DANCE) & ~low.rlike(PAST)
    body = F.substring("piece", F.greatest(dance, F.lit(1)), F.char_length("piece"))
    title = F.trim(F.substring(F.regexp_replace(F.regexp_replace(body, r"(?is)\s*lugar:.*$", ""), r"(?s)^[\s,:;.–-]+|[\s,:;.–-]+$", ""), 1, 180))
    found = seen.where(good).select(key, "ord", "n", "day", title.alias("titulo"), hour.alias("hora"), place.alias("lugar"), F.col("hora").isNull().alias("suelta"), known.alias("_known"), "piece", "cerca")
    # one line-up for each act, and names of the dictionary that it lacks
    told = found.withColumn("_who", line_up(F.col("piece")))
    lacks = lambda n: ~F.exists("_who", lambda x: F.contains(fold(x), fold(n)))
    told = told.withColumn("orquestas", F.concat("_who", F.filter("_known", lacks))).drop("_who", "_known", "piece")
    return once(told, key)


def once(found: DataFrame, key: str) -> DataFrame:
    """Acts of one section and hour whose titles hold one another are one: the
    first, with the names of all and the first venue."""
    group = Window.partitionBy(key, "ord", "hora").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("n", fold(F.col("titulo")).alias("t"))).over(group)
    low = fold(F.col("titulo"))
    twin = F.try_element_at(F.filter(earlier, lambda e: F.contains(e["t"], low) | F.contains(low, e["t"])), F.lit(1))["n"]
    of = found.withColumn("_twin", F.coalesce(twin, F.col("n")))
    # a twin's twin leads to the first of them
    first = F.min("_twin").over(Window.partitionBy(key, "ord", "hora", "_twin"))
    lead = of.withColumn("_of", F.least(first, F.col("_twin")))
    by = lambda c: F.min_by(c, "n")
    return lead.groupBy(key, "ord", "hora", "_of").agg(
        F.min("n").alias("n"), by("day").alias("day"), by("titulo").alias("titulo"), F.coalesce(F.min_by("lugar", F.when(F.col("lugar") != "", F.col("n"))), F.lit("")).alias("lugar"), by("suelta").alias("suelta"), by("cerca").alias("cerca"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "orquestas"))), lambda x: x["orquestas"]))).alias("orquestas"),
    ).select(key, "ord", "n", "day", "titulo", "hora", "lugar", "orquestas", "suelta", "cerca")
