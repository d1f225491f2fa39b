"""Texts as rows: what a pattern cuts them into, where each part begins, and
as-of joins between parts by their place.

A text is one key's rows. They are dealt by that key once; running sums and last
values are windows over them, so that no text is walked through in a task of its
own code, and no part is looked up in its text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs that hardly a text has, put before and after each match.
OPEN, CLOSE = "\x01", "\x02"


def cut(texts: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """(keys, i, hit, piece, pos): row 0 is what stands before the first match,
    each other one a match and what follows it; pos is where the row begins. Joined
    in order, hit and piece give the text again. Null counts as empty. The first of
    keys names one text.

    A text is searched once: matches are put between two signs, at which it is
    then split, as split by a pattern compiles it for each row and searches again.
    A text that has one of the signs itself is split by the pattern."""
    t = F.coalesce(text, F.lit(""))
    marked = F.concat(F.lit(CLOSE), F.regexp_replace(t, pattern, f"{OPEN}$0{CLOSE}"))
    apart = F.transform(F.split(marked, OPEN, -1), lambda x: F.struct(F.substring_index(x, CLOSE, 1).alias("hit"), F.substring_index(x, CLOSE, -1).alias("piece")))
    hits = F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    searched = F.arrays_zip(hits.alias("hit"), F.split(t, pattern, -1).alias("piece"))
    signs = F.contains(t, F.lit(OPEN)) | F.contains(t, F.lit(CLOSE))
    rows = texts.select(*keys, F.posexplode(F.when(signs, searched).otherwise(apart)).alias("i", "_p"))
    return placed(rows.select(*keys, "i", "_p.hit", "_p.piece"), keys[:1], F.char_length("hit") + F.char_length("piece"))


def parts(texts: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """(keys, i, piece, pos) of a pattern whose matches cover the text."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda p: p != "")
    rows = texts.select(*keys, F.posexplode(found).alias("i", "piece"))
    return placed(rows, keys, F.char_length("piece"))


def placed(rows: DataFrame, keys: list[str], length: Column, *order: str) -> DataFrame:
    """Adds pos, the sum of the lengths before each row, by i or the order named."""
    before = Window.partitionBy(*keys).orderBy(*order or ("i",)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pos", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("int"))


def last_before(value: Column, keys: list[str], *order: str, own: bool = True) -> Column:
    """The last value that is not null of the rows up to each one (or before it)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return F.last(value, True).over(w)


def first_after(value: Column, keys: list[str], *order: str) -> Column:
    """The first value that is not null of the rows after each one."""
    return F.first(value, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
