"""Days as dd-MM-yyyy text, the calendar gate, windows and rhythms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish weekdays from Monday and months from January.
WEEKDAYS = "lunes martes miercoles jueves viernes sabado domingo".split()
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def as_date(day: Column) -> Column:
    """The date of dd-MM-yyyy, null where it is none."""
    return F.try_to_date(day, "dd-MM-yyyy")


def day_text(date: Column) -> Column:
    return F.date_format(date, "dd-MM-yyyy")


def day_number(day: Column) -> Column:
    """yyyymmdd as int, 0 without a date."""
    d = as_date(day)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0)).cast("int")


def is_future(day: Column, today: str) -> Column:
    """On or after today; what has no date counts as to come."""
    return F.coalesce(as_date(day) >= F.lit(today).cast("date"), F.lit(True))


def month_number(name: Column) -> Column:
    """01-12 of a month's name (setiembre too), empty if it is none."""
    pairs = [x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))] + [F.lit("setiembre"), F.lit("09")]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(""))


def weekday_name(date: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date) + 1)


def weekday_holds(date: Column, named: Column) -> Column:
    """A header's weekday is that of its date; no weekday always holds."""
    return F.coalesce(named == weekday_name(date), F.lit(True))


def in_week(date: Column, today: str) -> Column:
    """From yesterday to the Sunday on or after it."""
    before = F.date_sub(F.lit(today).cast("date"), 1)
    return date.between(before, F.next_day(F.date_sub(F.lit(today).cast("date"), 1), "SUN"))


def rhythm(days: Column, failures: Column) -> Column:
    """How active an account is, by days since its last post."""
    return F.when(failures >= 3, "abandonada").when(days < 7, "caliente").when(days < 30, "templada").when(days < 365, "fria").otherwise("abandonada")


def month_context(text: Column) -> Column:
    """(mes, anyo) of the first month that a year follows ("SEPTIEMBRE 2026"), ''
    each without."""
    p = rf"\b({'|'.join([*MONTHS, 'setiembre'])})\b\s*(20\d\d)"
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(month_number(F.regexp_extract(low, p, 1)).alias("mes"), F.regexp_extract(low, p, 2).alias("anyo"))
