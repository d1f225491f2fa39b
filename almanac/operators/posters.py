"""Acts of a transcribed poster, dated by headers that follow each other: each
dated header is the reference from which the next one is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import dictionary
from almanac.operators.layout import rescued
from almanac.operators.spans import cut

#: Lines that tell of a dance.
DANCE = "verbena|gran baile|baile popular|baile de |noche latina|noche en blanco|latinazo|concierto bailable"
_WEEK = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo"
_HEAD = rf"(?iu)(?<!hasta )(?<!hasta el )\b({_WEEK})\b(?:,?\s+(?:d[ií]a\s+)?(\d{{1,2}})(?!\d|\s*[:.]\d)(?:\s*de\s+({'|'.join([*D.MONTHS, 'setiembre'])}))?)?"


def after(reference: Column, weekday: Column, day: Column, month: Column) -> Column:
    """The date that a header tells, read from a reference: a day and month of
    its year, or of the next where that is over; a day alone in its month or
    the next, within 62 days, else eleven months on; a weekday (0 Monday) alone
    on or after it. Null where there is no such date."""
    at = lambda first: F.try_to_date(F.concat_ws("-", F.date_format(first, "yyyy-M"), day.cast("string")), "yyyy-M-d")
    january = F.trunc(reference, "year")
    dated = lambda y: at(F.add_months(january, month - 1 + 12 * y))
    told = F.when(dated(0) >= F.date_sub(reference, 1), dated(0)).otherwise(dated(1))
    near = F.filter(F.array(*[at(F.add_months(F.trunc(reference, "month"), n)) for n in (0, 1, 11)]), lambda d: d >= F.date_sub(reference, 1))
    following = F.date_add(reference, F.pmod(weekday - F.weekday(reference), F.lit(7)))
    return F.when(month.isNotNull(), told).when(day.isNotNull(), F.try_element_at(near, F.lit(1))).otherwise(following)


def moving_dates(heads: Column, reference: Column) -> Column:
    """The dates of headers (weekday, day, month) in order; one without a date
    leaves the reference where it is."""
    start = F.struct(reference.alias("ref"), F.array().cast("array<date>").alias("out"))

    def step(state: Column, h: Column) -> Column:
        d = after(state["ref"], h["weekday"], h["day"], h["month"])
        return F.struct(F.coalesce(d, state["ref"]).alias("ref"), F.concat(state["out"], F.array(d)).alias("out"))

    return F.aggregate(heads, start, step, lambda s: s["out"])


def poster_acts(posters: DataFrame, key: str, text: str, reference: str, names: list[str] = ()) -> DataFrame:
    """(key, ord, day, hora, titulo, orquestas): lines of 10 to 160 characters
    that tell of a dance, or of an orchestra with an hour, below a header with
    a weekday ("hasta el sábado" is none). Titles are cut at 90 characters.
    names: a dictionary of bounded size. Null texts have no acts."""
    rows = cut(posters.withColumn("_ref", F.col(reference)), [key, "_ref"], F.col(text), _HEAD).where("i > 0")
    part = lambda i: F.nullif(F.lower(F.regexp_extract("hit", _HEAD, i)), F.lit(""))
    week = F.array(*map(F.lit, D.WEEKDAYS))
    number = F.nullif(D.month_number(part(3)), F.lit("")).cast("int")
    heads = rows.select(key, "_ref", F.struct("i", (F.array_position(week, T.fold(part(1))) - 1).cast("int").alias("weekday"), part(2).try_cast("int").alias("day"), number.alias("month"), "piece").alias("_h"))
    held = heads.groupBy(key, "_ref").agg(F.array_sort(F.collect_list("_h")).alias("_s"))
    dated = held.select(key, F.posexplode(F.arrays_zip("_s", moving_dates(F.col("_s"), F.col("_ref")).alias("day"))).alias("ord", "_d"))
    sections = dated.select(key, "ord", D.day_text(F.col("_d.day")).alias("day"), F.col("_d._s.piece").alias("_t")).where("day IS NOT NULL")
    line = F.regexp_replace(F.trim(F.col("_l")), r"^[•*·—|>\-\s]+", "")
    lines = sections.select(key, "ord", "day", F.posexplode(F.split("_t", "\n")).alias("_n", "_l")).select(key, "ord", "day", F.concat_ws("|", F.col(key).cast("string"), "ord", "_n").alias("_k"), line.alias("_l"))
    folded, hour = T.fold(F.col("_l")), F.regexp_extract("_l", r"\d{1,2}:\d{2}", 0)
    told = folded.rlike(DANCE) | (folded.rlike("orquesta") & (hour != ""))
    kept = lines.where(F.char_length("_l").between(10, 160) & told)
    if names:
        kept = kept.join(rescued(kept, "_k", F.col("_l"), dictionary.of(posters.sparkSession, list(names))), "_k", "left")
    else:
        kept = kept.withColumn("nombres", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    return kept.select(key, "ord", "day", hour.alias("hora"), F.substring("_l", 1, 90).alias("titulo"), F.coalesce("nombres", none).alias("orquestas"))
