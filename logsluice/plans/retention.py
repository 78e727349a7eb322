"""Retention: what is past its time, and taking it off the stored table."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.operators.stats import expired, prune_breakdown
from logsluice.schema import as_utc
from logsluice.sources.entries import rewrite_days, stored_days

# Fixed value: days kept when nothing else is said.
KEEP_DAYS = 30


class PrunePreview(NamedTuple):
    total: DataFrame
    by_level: DataFrame


def effective_days(days: int | None, enabled: bool, keep_days: int = KEEP_DAYS) -> int | None:
    """Days to keep; ``None`` when nothing is to be deleted. Zero counts as not given."""
    if days:
        return days
    return keep_days if enabled else None


def prune(
    df: DataFrame, now: datetime, days: int | None = None, enabled: bool = True
) -> DataFrame:
    """The entries that stay. Rows exactly at the limit stay too."""
    keep = effective_days(days, enabled)
    if keep is None:
        return df
    return df.where(~F.coalesce(expired(df, now, keep), F.lit(False)))


def prune_preview(
    df: DataFrame, now: datetime, days: int | None = None, enabled: bool = True
) -> PrunePreview:
    """How many rows a prune would delete, and of which levels. Deletes nothing."""
    keep = effective_days(days, enabled)
    old = expired(df, now, keep) if keep is not None else F.lit(False)
    total = df.agg(F.count_if(old).alias("count"))
    by_level = prune_breakdown(df if keep is not None else df.limit(0), now, keep or KEEP_DAYS)
    return PrunePreview(total, by_level)


def prune_table(
    spark: SparkSession,
    path: str,
    now: datetime,
    days: int | None = None,
    enabled: bool = True,
) -> None:
    """Takes expired entries off the stored table.

    Whole days past the limit go as folders, unread; only the day the limit falls into is
    rewritten. Both come into effect together, and a prune that failed is simply run again.
    """
    keep = effective_days(days, enabled)
    if keep is None:
        return
    limit = as_utc(now) - timedelta(days=keep)
    days = stored_days(spark, path)
    past = [day for day in days if day < limit.date()]
    rewrite_days(spark, path, [limit.date()], lambda rows: prune(rows, now, keep), drop=past)
