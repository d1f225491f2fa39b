"""Explainable additive scoring: a rule set becomes a score and its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Points and a reason for rows that meet a condition. `group`: of the
    rules of one group only the first that holds counts."""

    reason: str | Column
    points: int | Column
    when: Column
    group: str | None = None


def scored(df: DataFrame, rules: list[Rule], accept: int = 4) -> DataFrame:
    """Adds score, motivos (reasons in rule order) and aceptado."""
    parts: dict[str, Column | None] = {}
    for i, r in enumerate(rules):
        key = r.group or f"#{i}"
        hit = F.struct(F.lit(r.points).cast("int").alias("points"), F.lit(r.reason).alias("reason"))
        met = F.coalesce(r.when, F.lit(False))
        parts[key] = F.when(met, hit) if key not in parts else F.coalesce(parts[key], F.when(met, hit))
    hits = F.filter(F.array(*parts.values()), lambda x: x.isNotNull())
    return (
        df.withColumn("_hits", hits)
        .withColumn("score", F.aggregate("_hits", F.lit(0), lambda a, x: a + x["points"]))
        .withColumn("motivos", F.transform("_hits", lambda x: x["reason"]))
        .withColumn("aceptado", F.col("score") >= accept)
        .drop("_hits")
    )
