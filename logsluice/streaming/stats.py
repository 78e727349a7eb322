"""Counts per level kept up to date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.operators.stats import quarter_counts, stats_by_level


def stats_quarters_stream(entries: DataFrame) -> DataFrame:
    """Counts per level and quarter of an hour, for a clock that moves on.

    Written in complete or update mode, ``stats_of_quarters`` tells totals, today and this
    hour at any time, also long after the stream was started. The state has one row
    per level and quarter.
    """
    return quarter_counts(entries)


def stats_stream(
    entries: DataFrame,
    now: datetime | None = None,
    tz: str = "UTC",
    window: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """A streaming aggregation with one state row per level (and window).

    Without a window it is :func:`stats_by_level` in complete or update mode, at the fixed
    time ``now``; :func:`stats_quarters_stream` is for a stream that outlives the day.
    With one it counts per event-time window, which can also be appended once
    the watermark has passed.
    """
    if window is None:
        if now is None:
            raise ValueError("counts of today and this hour need now=")
        return stats_by_level(entries, now, tz)
    return (
        entries.withWatermark("occurred_at", delay)
        .groupBy(F.window("occurred_at", window), "level")
        .agg(F.count(F.lit(1)).alias("total"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "level",
            "total",
        )
    )
