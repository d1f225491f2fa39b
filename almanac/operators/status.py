"""The state of a run: totals at several levels in one pass, and what waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of alerts about documents that wait for their text.
PENDING = ("programa-pdf", "pdf-escaneado", "programa-imagen")


def is_pending(kind: Column, read: Column) -> Column:
    """An alert of a document that waits for its text, and has none yet."""
    return F.coalesce(kind.isin(*PENDING) & ~F.coalesce(read, F.lit(False)), F.lit(False))


def totals(rows: DataFrame, levels: list[list[str]], **counted: Column) -> DataFrame:
    """n and the counts named (rows that meet a condition) of all rows at each
    level, a list of columns; the empty list is all of them. nivel names the level's
    columns, joined by comma ('' for all); columns that are not of the level are
    null, as is a null of the rows' own. One scan; rows are summed up before they
    are shuffled, so that the level of all rows is a few rows for each task. No rows give
    no level."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    sums = [F.count("*").alias("n"), *[F.count_if(v).alias(c) for c, v in counted.items()]]
    return rows.groupingSets([[F.col(c) for c in one] for one in levels], *names).agg(level.alias("nivel"), *sums).select("nivel", *names, "n", *counted)


def sources(rows: DataFrame, registered: DataFrame) -> DataFrame:
    """registered (fuente, and others) with eventos, how many rows (fuente) each
    has, and ok: whether it has any; a registered one without rows stays."""
    n = rows.groupBy("fuente").agg(F.count("*").alias("eventos"))
    return registered.join(n, "fuente", "left").withColumn("eventos", F.coalesce("eventos", F.lit(0).cast("long"))).withColumn("ok", F.col("eventos") > 0)
