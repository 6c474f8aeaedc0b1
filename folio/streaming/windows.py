"""Event streams: windows and deduplication behind a watermark. Columns: ts, user_id, event_type, event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, late: str = "1 hour", files: int = 16) -> DataFrame:
    """The Parquet files of a folder as a stream; ts becomes a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def metered(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Events of each user in sliding windows (width = step: tumbling)."""
    counts = events.groupBy(F.window("ts", width, step), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    counts = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), "user_id", "n")


def once(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))
