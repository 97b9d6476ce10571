"""Windowed counts of an event stream; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timely(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and exact sums per event type; rows later than the watermark are dropped in a stream."""
    agg = _timely(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Start, end (of its last event), count and exact sum of each key's sessions: events less than ``gap`` apart.

    A stream gives a session when the watermark has passed its end.
    """
    agg = _timely(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return agg.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n", F.col("total").cast("double").alias("total"))
