"""Sessions, feature windows, segments and alerts over events (event_id, ts,
user_id, event_type, value), for tables and for streams alike. With
``watermark`` late rows are dropped and state is kept bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _late(events: DataFrame, watermark: str | None) -> DataFrame:
    return events.withWatermark("ts", watermark) if watermark else events


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n_events, total): runs of a user's
    events without a gap; the end is the last event's time plus the gap."""
    g = _late(events, watermark).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def feature_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(event_type, window_start, window_end, n_events, mean, most); the start is
    inside, the end is not."""
    g = _late(events, watermark).groupBy("event_type", F.window("ts", size, slide or size).alias("w"))
    return g.agg(F.count("*").alias("n_events"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("event_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "mean", "most")


def alerts(windows: DataFrame, least_events: int) -> DataFrame:
    """Feature windows with at least so many events."""
    return windows.where(F.col("n_events") >= least_events)


def segments(events: DataFrame) -> DataFrame:
    """``events`` with ``sequence_index``, from 0, in each user's order of time."""
    return events.withColumn("sequence_index", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


def deduplicated(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first of the rows with one event_id."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if watermark else events.dropDuplicates(["event_id"])
