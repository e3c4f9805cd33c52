"""Streams over the event log: late and repeated events, windows, sessions, and a state table kept by upserts.

Each takes a streaming DataFrame and gives one; sinks and checkpoints are the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(events: DataFrame, event_id: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as repeats come within the watermark; state is bounded by it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])


def windowed(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind in tumbling or sliding windows."""
    window = F.window(at, size, slide or size)
    grouped = events.withWatermark(at, late).groupBy(window, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def keep_state(path: str, key: str):
    """A foreachBatch function that adds a batch (key, at, validated) to the state table at `path`, a folder per batch:
    a batch that runs again writes the same folder, so nothing is counted twice."""
    from lumenfold.operators.relational import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], f"{key} {batch.schema[key].dataType.simpleString()}, seen long, first_at timestamp, last_at timestamp, validated boolean")
        before = spark.read.schema(empty.schema).parquet(f"{path}/{number - 1}") if number else empty
        upsert(before, batch, key).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
