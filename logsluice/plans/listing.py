"""The search page: filters, search, one page and its footer."""

from __future__ import annotations

from datetime import date, datetime, time, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.bounds import resolve_range
from logsluice.operators.filters import apply_filters
from logsluice.operators.paging import (
    COUNT_CAP,
    after_cursor,
    clamp_per_page,
    count_up_to,
    make_cursor,
    page,
    page_meta,
    read_cursor,
    recent,
)
from logsluice.plans.changes import current_entries
from logsluice.schema import as_utc, time_type, to_wall
from logsluice.sources.entries import read_entries, stored_days

# What the footer of a page says.
META = "has_next boolean, next_cursor string, per_page int, count long, has_next_count boolean"
# An empty page is read from an empty stretch of time.
FIRST = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Listing(NamedTuple):
    rows: DataFrame
    meta: DataFrame


def list_entries(
    df: DataFrame,
    per_page: int | None = None,
    cursor: str | None = None,
    wide: bool = True,
    **params,
) -> Listing:
    """A page of the filtered entries; the footer counts from the cursor on."""
    rest = apply_filters(df, **params)
    return Listing(page(rest, per_page, cursor, wide), page_meta(rest, per_page, cursor))


def list_table(
    spark: SparkSession,
    path: str,
    per_page: int | None = None,
    cursor: str | None = None,
    wide: bool = True,
    log: str | None = None,
    **params,
) -> Listing:
    """The same on a stored table, in as few of its newest days as the page and its count need.

    Each of these days is scanned once, for times and ids alone: the newest of them, one
    more than the count's cap, give the footer at once. The page's rows are then read by
    their ids from the stretch of time they lie in. With ``log`` entries have the status
    that the change log gives them.
    """
    size = clamp_per_page(per_page)
    keys = _newest_keys(spark, path, cursor, COUNT_CAP + 1, log, params)
    told = keys[:size]
    more = len(keys) > size
    meta = (
        more,
        make_cursor(*told[-1]) if more else None,
        size,
        min(len(keys), COUNT_CAP),
        len(keys) > COUNT_CAP,
    )
    low, high = (as_utc(told[-1][0]), as_utc(told[0][0])) if told else (FIRST, FIRST)
    rows = _stored(spark, path, log, low, high).where(F.col("id").isin([entry_id for _, entry_id in told]))
    return Listing(
        page(apply_filters(rows, **params), per_page, cursor, wide), spark.createDataFrame([meta], META)
    )


def newest_page(
    spark: SparkSession,
    path: str,
    per_page: int | None = None,
    cursor: str | None = None,
    wide: bool = True,
    log: str | None = None,
    **params,
) -> DataFrame:
    """Only the page of :func:`list_table`, which may open fewer days still."""
    size = clamp_per_page(per_page)
    return page(_newest_rest(spark, path, cursor, size, log, params), per_page, cursor, wide)


def _stored(
    spark: SparkSession, path: str, log: str | None, since: datetime | None, until: datetime | None
) -> DataFrame:
    return current_entries(spark, path, log, since, until) if log else read_entries(spark, path, since, until)


def _days_in(spark: SparkSession, path: str, low: datetime | None, high: datetime | None) -> list[date]:
    """The table's days in this range, newest first."""
    return sorted(
        (
            day
            for day in stored_days(spark, path)
            if (low is None or day >= low.date()) and (high is None or day <= high.date())
        ),
        reverse=True,
    )


def _newest_keys(
    spark: SparkSession, path: str, cursor: str | None, wanted: int, log: str | None, params: dict
) -> list[tuple[datetime, str]]:
    """UTC time and id of the first ``wanted`` entries after the cursor, newest first.

    Days are looked through from the newest, four times as many in each further look, until
    there are enough. Every day is looked through once, as older ones only add to what
    newer ones gave.
    """
    low, high = _time_range(cursor, params)
    days = _days_in(spark, path, low, high)
    keys: list[tuple[datetime, str]] = []
    span = 1
    while days and len(keys) < wanted:
        part, days = days[:span], days[span:]
        since = datetime.combine(part[-1], time(), timezone.utc)
        until = datetime.combine(part[0], time.max, timezone.utc)
        rows = _stored(
            spark, path, log, since if low is None else max(since, low), until if high is None else min(until, high)
        )
        rest = after_cursor(apply_filters(rows, **params), cursor).select("occurred_at", "id")
        wall = F.col("occurred_at") if isinstance(time_type(rest), T.TimestampNTZType) else to_wall(F.col("occurred_at"))
        newest = recent(rest).limit(wanted - len(keys)).select(wall.alias("at"), "id")
        keys += [(row["at"], row["id"]) for row in newest.collect()]
        span *= 4
    return keys


def _newest_rest(
    spark: SparkSession, path: str, cursor: str | None, wanted: int, log: str | None, params: dict
) -> DataFrame:
    """The filtered entries of the newest days that hold ``wanted`` rows after the cursor.

    Days are added until they do; each look is a small job, and each adds four times
    the days of the one before. Older days cannot come first, so they are never
    opened.
    """
    low, high = _time_range(cursor, params)
    days = _days_in(spark, path, low, high)
    span = 1
    while True:
        since = low
        if span < len(days):
            since = datetime.combine(days[span - 1], time(), timezone.utc)
            since = since if low is None else max(since, low)
        rest = apply_filters(_stored(spark, path, log, since, high), **params)
        if span >= len(days) or count_up_to(after_cursor(rest, cursor), wanted)[0] == wanted:
            return rest
        span *= 4


def _time_range(cursor: str | None, params: dict) -> tuple[datetime | None, datetime | None]:
    """The time range that the filters and the cursor leave."""
    low, high = resolve_range(
        params.get("from_"), params.get("to"), params.get("tz", "UTC"), params.get("now")
    )
    position = read_cursor(cursor)
    if position is not None:
        high = min(filter(None, [high, as_utc(position[0])]))
    return low, high
