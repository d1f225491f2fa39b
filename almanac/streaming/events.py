"""Structured Streaming over landed event files, run until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import shared_dir


def landed(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A stream of the files of a landed table."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run the stream over what has landed; each batch replaces (complete) or
    adds to (append) an idempotent folder by its number."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/{'all' if mode == 'complete' else f'batch-{number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/data")


def first_seen(stream: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    """Each key once in whatever batches it comes, as long as it comes again
    within `late` of its last time: state is dropped after that, and what is
    stored is told apart by store.novel."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).select(key)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n", "cents")


def on_time(stream: DataFrame, day: str) -> DataFrame:
    """Past events are never taken in."""
    return stream.where(F.col("ts") >= F.lit(day).cast("timestamp")).select("event_id", "user_id", "event_type")
