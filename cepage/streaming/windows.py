"""Extensions for event streams: windowed counts with a watermark, and running last values.

Both take a streaming or a batch DataFrame and give the same rows for the same events, late ones aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, by: list[str], length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Count and sum of values per window and group; events later than ``late`` behind the newest are dropped in streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = timed.groupBy(at.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Sessions: events of a group that follow each other within ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return sums.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
