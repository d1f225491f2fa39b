"""Who works on what, and when a failed task may be tried again: a versioned
table of leases that several workers take from at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import versions as V

LEASES = "clave string, quien string, hasta long, fallos int, proximo long"
HOUR = 3_600_000


def free(tasks: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Tasks (clave) that nobody holds and whose pause after a failure is over."""
    busy = leases.where((F.col("hasta") > now) | (F.col("proximo") > now)).select("clave")
    return tasks.select("clave").where("clave IS NOT NULL").distinct().join(busy, "clave", "left_anti")


def take(spark: SparkSession, root: str, tasks: DataFrame, who: str, now: int, most: int, held: int = HOUR) -> DataFrame:
    """The tasks that `who` now holds for a while: up to `most` (a top-k) of the
    free ones. Two workers never get the same task."""

    def change(leases: DataFrame, _: dict) -> tuple[DataFrame | None, dict]:
        mine = free(tasks, leases, now).orderBy("clave").limit(most).select("clave", F.lit(who).alias("_quien"))
        both = leases.join(mine, "clave", "full_outer")
        new = F.col("_quien").isNotNull()
        return both.select("clave", F.coalesce("_quien", "quien").alias("quien"), F.when(new, now + held).otherwise(F.col("hasta")).alias("hasta"), F.coalesce("fallos", F.lit(0)).alias("fallos"), F.coalesce("proximo", F.lit(0)).cast("long").alias("proximo")), {}

    version = V.update(spark, root, LEASES, change)
    return V.read(spark, root, LEASES, version).where((F.col("quien") == who) & (F.col("hasta") == now + held)).select("clave")


def give_back(spark: SparkSession, root: str, done: DataFrame, who: str, now: int, pause: int = 6 * HOUR) -> int:
    """Return tasks (clave, bien) that `who` held: those done are forgotten,
    those that failed pause, twice as long after each failure in a row."""

    def change(leases: DataFrame, _: dict) -> tuple[DataFrame | None, dict]:
        told = done.groupBy("clave").agg(F.max("bien").alias("_bien"))
        met = leases.join(told, "clave", "left")
        mine = (F.col("quien") == who) & F.col("_bien").isNotNull()
        failed = mine & ~F.col("_bien")
        wait = F.lit(pause) * F.pow(F.lit(2), F.least(F.col("fallos"), F.lit(6))).cast("long")
        kept = met.where(~F.coalesce(mine & F.col("_bien"), F.lit(False)))
        return kept.select("clave", "quien", F.when(failed, now).otherwise(F.col("hasta")).alias("hasta"), F.when(failed, F.col("fallos") + 1).otherwise(F.col("fallos")).alias("fallos"), F.when(failed, now + wait).otherwise(F.col("proximo")).alias("proximo")), {}

    return V.update(spark, root, LEASES, change)
