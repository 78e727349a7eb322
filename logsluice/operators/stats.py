"""Counts per level, totals and facets: one aggregation each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.bounds import start_of
from logsluice.schema import as_utc, epoch_micros, instant, time_type


def _since(df: DataFrame, unit: str, now: datetime, tz: str) -> Column:
    return F.col("occurred_at") >= instant(start_of(unit, now, tz), time_type(df))


def stats_by_level(df: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """Per level: all rows, rows since local midnight, rows since the full hour."""
    return df.groupBy("level").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_since(df, "day", now, tz)).alias("today"),
        F.count_if(_since(df, "hour", now, tz)).alias("this_hour"),
    )


# Days and hours of every time zone begin with a quarter of an hour.
QUARTER = 900


def quarter_counts(df: DataFrame) -> DataFrame:
    """(level, quarter, n): counts from which any later clock can tell today and this hour."""
    seconds = epoch_micros(F.col("occurred_at"), time_type(df)) / 1_000_000
    return df.groupBy("level", F.floor(seconds / QUARTER).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


def stats_of_quarters(counts: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """:func:`stats_by_level` at ``now`` from counts by quarter of an hour."""

    def since(unit: str) -> Column:
        first = int(as_utc(start_of(unit, now, tz)).timestamp()) // QUARTER
        return F.coalesce(F.sum(F.when(F.col("quarter") >= first, F.col("n"))), F.lit(0)).cast("bigint")

    return counts.groupBy("level").agg(
        F.sum("n").alias("total"), since("day").alias("today"), since("hour").alias("this_hour")
    )


def stats_total(df: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """One row of sums over the levels, with the totals by level as a JSON object."""
    pairs = F.sort_array(F.collect_list(F.struct("level", "total")))
    return stats_by_level(df, now, tz).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.to_json(F.map_from_entries(pairs)).alias("by_level"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today"),
        F.coalesce(F.sum("this_hour"), F.lit(0)).alias("this_hour"),
    )


def facet(df: DataFrame, column: str, contains: str | None = None) -> DataFrame:
    """The column's distinct values in order, nulls left out."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    if contains and contains.strip():
        part = F.lit(contains.strip().lower())
        values = values.where(F.contains(F.lower(F.col("value")), part))
    return values.distinct().orderBy("value")


def expired(df: DataFrame, now: datetime, days: int) -> Column:
    cutoff = as_utc(now) - timedelta(days=days)
    return F.col("occurred_at") < instant(cutoff, time_type(df))


def prune_breakdown(df: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Rows past retention per level, most first."""
    return (
        df.where(expired(df, now, days))
        .groupBy(F.upper("level").alias("level"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "level")
    )
