"""A progress board over a stream of events, and over finished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed_progress(events: DataFrame, key: str = "event_type", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and key: events, total and last value. Rows later than the watermark are left out; works on a
    stream and on a table."""
    ready = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = ready.groupBy(F.window("at", size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", "event_id").alias("last_value"))
    return g.select(F.col("window.start").alias("start"), key, "n", "total", "last_value")


def stream_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_once(board: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; closed windows only in append mode."""
    board.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def eta(done: DataFrame, left: DataFrame, earlier: DataFrame, key: str, seconds: str) -> DataFrame:
    """One row: seconds left, from the earlier run's times scaled by how this run compares on what both have."""
    both = done.select(key, F.col(seconds).alias("now")).join(earlier.select(key, F.col(seconds).alias("then")), key)
    ratio = both.agg((F.sum("now") / F.sum("then")).alias("ratio"))
    rest = left.select(key).join(earlier.select(key, F.col(seconds).alias("then")), key, "left").agg(F.coalesce(F.sum("then"), F.lit(0.0)).alias("then"), F.count(F.lit(1)).alias("pending"))
    return rest.crossJoin(ratio).select("pending", (F.col("then") * F.coalesce("ratio", F.lit(1.0))).alias("seconds_left"))  # one row each


def latest(df: DataFrame, order: Sequence[str], n: int = 8) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
