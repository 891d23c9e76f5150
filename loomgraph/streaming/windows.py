"""Event-time aggregates, the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Events and their value by type in windows of one length; ``late`` is how long a stream waits."""
    return _counted(events, F.window("ts", length), late)


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    return _counted(events, F.window("ts", length, step), late)


def _counted(events: DataFrame, window, late: str | None) -> DataFrame:
    watched = events.withWatermark("ts", late) if late else events
    counted = watched.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """A user's runs of events less than ``gap`` apart."""
    watched = events.withWatermark("ts", late) if late else events
    counted = watched.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")
