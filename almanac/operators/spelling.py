"""Lookup with one spelling error, by deletion neighbourhoods.

Two words within one edit share a form: one of them, or one of them without
one letter. Forms are join keys, so that near words meet by an equi-join, and
what meets is verified; nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import fold


def forms(word: Column) -> Column:
    """A word and what it is without each one of its letters."""
    n = F.char_length(word)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), less))


def near(words: DataFrame, names: DataFrame, word: str = "palabra", name: str = "nombre") -> DataFrame:
    """(word, name, distancia) of distinct words and names (columns of these
    names) within one edit of each other, folded. Null words have none."""
    left = words.where(F.col(word).isNotNull()).select(word).distinct().withColumn("_w", fold(F.col(word)))
    right = names.where(F.col(name).isNotNull()).select(name).distinct().withColumn("_n", fold(F.col(name)))
    met = left.select(word, "_w", F.explode(forms(F.col("_w"))).alias("_form")).join(right.select(name, "_n", F.explode(forms(F.col("_n"))).alias("_form")), "_form")
    pairs = met.select(word, name, "_w", "_n").distinct()
    return pairs.select(word, name, F.levenshtein("_w", "_n").alias("distancia")).where("distancia <= 1")


def nearest(words: DataFrame, names: DataFrame, word: str = "palabra", name: str = "nombre") -> DataFrame:
    """(word, name) of the nearest name of each word that has one; ties to the
    first in order of name."""
    best = near(words, names, word, name).groupBy(word).agg(F.min(F.struct("distancia", name)).alias("_b"))
    return best.select(word, F.col(f"_b.{name}").alias(name))


def table(names: list[str]) -> dict[str, list[str]]:
    """The forms of a small fixed set of words, each with the words that have it."""
    out: dict[str, list[str]] = {}
    for n in names:
        for f in {n, *(n[:i] + n[i + 1 :] for i in range(len(n)))}:
            out.setdefault(f, []).append(n)
    return out


def corrected(word: Column, names: list[str], least_shared: int = 0) -> Column:
    """The first of a small fixed set of folded words within one edit of a
    folded word, that begins with the same letters; null without. Its forms
    are looked up in the set's forms."""
    known = F.create_map(*[x for f, ns in table(names).items() for x in (F.lit(f), F.array(*map(F.lit, ns)))])
    met = F.array_distinct(F.flatten(F.filter(F.transform(forms(word), lambda f: F.try_element_at(known, f)), lambda a: a.isNotNull())))
    good = lambda n: (F.levenshtein(word, n) <= 1) & (F.substring(n, 1, least_shared) == F.substring(word, 1, least_shared))
    order = F.array(*map(F.lit, names))
    ranked = F.array_sort(F.transform(F.filter(met, good), lambda n: F.struct(F.levenshtein(word, n).alias("d"), F.array_position(order, n).alias("i"), n.alias("n"))))
    return F.try_element_at(ranked, F.lit(1))["n"]
