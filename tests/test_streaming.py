"""Streams against the same windows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.streaming import windows


def _run(df, name, folder):
    df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination(120)
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


def test_windows_of_a_stream_equal_those_in_batch(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    events = windows.stream(spark, str(tmp_path / "in"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert _run(windows.metered(events, "1 day", "1 day"), "metered", tmp_path / "a") == {tuple(r) for r in windows.metered(batch, "1 day", "1 day").collect()}
    assert _run(windows.sessions(events), "sessions", tmp_path / "b") == {tuple(r) for r in windows.sessions(batch).collect()}


def test_a_key_passes_once(spark, sf_dir, tmp_path):
    """Of events of one user and type within the watermark the first passes."""
    spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "event_id").repartition(1).write.parquet(str(tmp_path / "in"))
    once = windows.once(windows.stream(spark, str(tmp_path / "in"), "40 days"), "user_id", "event_type")
    once.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.user_id, r.event_type) for r in spark.table("once").collect()]
    want = {tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want
