"""Names as a reader orders and compares them: in the order of a language, and
regardless of case and marks.

Orders and comparisons are collations, so that sorts, joins, groups and windows use
them as they use plain text. In Spanish ñ is a letter of its own, after n, with or
without marks counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import unused


def in_order(name: Column, language: str = "es") -> Column:
    """A name to order by, as the language has it: a before Á before b."""
    return F.collate(name, language)


def regardless(name: Column, language: str = "es") -> Column:
    """A name to compare by, whatever its case and marks: Ángel is ANGEL."""
    return F.collate(F.trim(name), f"{language}_CI_AI")


def sorted_by_name(rows: DataFrame, name: str, *then: str, language: str = "es") -> DataFrame:
    """Rows in the language's order of a column, nulls first; equal names by
    their bytes, then by the columns named."""
    return rows.orderBy(in_order(F.col(name), language), name, *then)


def joined_by_name(left: DataFrame, right: DataFrame, name: str, language: str = "es", how: str = "inner") -> DataFrame:
    """Rows of left with those of right (name, and columns that left lacks) whose
    name is the same regardless of case and marks; left's name stays. Null names
    meet none."""
    key = unused(right, *unused(left, "_name"))[0]
    keyed = lambda df: df.withColumn(key, regardless(F.col(name), language))
    return keyed(left).join(keyed(right).drop(name), key, how).drop(key)


def one_spelling(rows: DataFrame, name: str, language: str = "es") -> DataFrame:
    """(name, n) of names that are the same regardless of case and marks: the
    spelling used most, of equal ones the first in the language's order, and how many
    rows have any of them. Spellings are counted before names meet."""
    each = rows.where(F.col(name).isNotNull()).groupBy(F.trim(F.col(name)).alias(name)).agg(F.count("*").alias("n"))
    least = F.min_by(name, F.struct(-F.col("n"), in_order(F.col(name), language), F.col(name)))
    return each.groupBy(regardless(F.col(name), language).alias("_k")).agg(least.alias(name), F.sum("n").alias("n")).drop("_k")
