"""Event-time windows, the same plan over a batch or a stream. An extension: deduplication, watermarks, late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts and sums per hour and type; `late` is the watermark of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("at", late)
    sums = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def distinct_stream(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """A stream without events that repeat within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
