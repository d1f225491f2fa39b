"""Connected parts of rows that share something.

Rows and what they share come as (id, hub). Stars replace the hubs: each row points
to the smallest row of its hub, and stars are then folded into each other until
every row points to the smallest of its part. Each step is an aggregate of minima,
summed up before it is shuffled, and a join back to its keys, so that a hub that a
third of all rows share costs its rows once and never their pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import forget, made, materialize


def parts(links: DataFrame) -> DataFrame:
    """(id, parte) of each id that shares a hub with a smaller one, directly or
    by others; parte is the smallest id of its part. Smallest ids, ids that share
    nothing, and null ids or hubs have no row. Each round is written and read
    back; rounds grow with the logarithm of a part's width."""
    spark, since = links.sparkSession, made()
    links = materialize(links.where("id IS NOT NULL AND hub IS NOT NULL"), "links")
    low = links.groupBy("hub").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("hub", "m")
    edges = materialize(links.join(low, "hub").where("id > m").select(F.col("id").alias("u"), F.col("m").alias("v")).distinct(), "parts")
    before = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(inner.union(low.select("u", "m")).distinct(), "parts")
        forget(spark, since, made() - 1)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("parte"))
