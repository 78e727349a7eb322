"""Newest-first listing with keyset paging and a capped count."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.schema import LIST_COLUMNS, instant, time_type, to_wall

# Page size bounds and the count at which counting stops.
PER_PAGE = 50
MAX_PER_PAGE = 100
COUNT_CAP = 1000

def newest_first() -> list[Column]:
    return [F.col("occurred_at").desc(), F.col("id").desc()]


def recent(df: DataFrame) -> DataFrame:
    return df.orderBy(*newest_first())


def list_view(df: DataFrame, wide: bool = True) -> DataFrame:
    """The columns of a listing; ``wide`` adds the full message and context."""
    columns = list(LIST_COLUMNS)
    if wide:
        columns[2:2] = ["message", "context"]
    return df.select(*columns)


def find(df: DataFrame, entry_id: str) -> DataFrame:
    """The entry with this id; an empty frame when there is none."""
    return df.where(F.col("id") == entry_id).limit(1)


def make_cursor(occurred_at: datetime, entry_id: str) -> str:
    text = json.dumps({"occurred_at": occurred_at.strftime("%Y-%m-%d %H:%M:%S.%f"), "id": entry_id})
    return base64.b64encode(text.encode()).decode()


def read_cursor(cursor: str | None) -> tuple[datetime, str] | None:
    """Time and id of a cursor; ``None`` for anything unreadable."""
    try:
        data = json.loads(base64.b64decode(cursor or "", validate=True))
        return datetime.fromisoformat(data["occurred_at"]), str(data["id"])
    except (binascii.Error, ValueError, TypeError, KeyError):
        return None


def after_cursor(df: DataFrame, cursor: str | None) -> DataFrame:
    """Rows that come after the cursor's row; an unreadable cursor is ignored."""
    position = read_cursor(cursor)
    if position is None:
        return df
    at, entry_id = instant(position[0], time_type(df)), position[1]
    when = F.col("occurred_at")
    # The plain upper bound is implied by the rest; alone it is a range that
    # the scan can prune by.
    return df.where((when <= at) & ((when < at) | (F.col("id") < entry_id)))


def clamp_per_page(per_page: int | None) -> int:
    return max(1, min(PER_PAGE if per_page is None else int(per_page), MAX_PER_PAGE))


def page(
    df: DataFrame, per_page: int | None = None, cursor: str | None = None, wide: bool = True
) -> DataFrame:
    """One page, newest first. Sort and limit run as a top-k, not a full sort."""
    rows = recent(after_cursor(df, cursor)).limit(clamp_per_page(per_page))
    return list_view(rows, wide) if set(LIST_COLUMNS) <= set(df.columns) else rows


def capped_count(df: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """``count`` up to the cap and whether there is more; each task stops early."""
    seen = df.select(F.lit(1).alias("one")).limit(cap + 1)
    return seen.agg(F.count(F.lit(1)).alias("n")).select(
        F.least(F.col("n"), F.lit(cap).cast("bigint")).alias("count"),
        (F.col("n") > cap).alias("has_next_count"),
    )


def count_up_to(df: DataFrame, cap: int = COUNT_CAP) -> tuple[int, bool]:
    """The same at once: Spark reads only as many partitions as it needs."""
    seen = len(df.select(F.lit(1)).take(cap + 1))
    return min(seen, cap), seen > cap


def cursor_column(occurred_at: Column, entry_id: Column, dtype: T.DataType) -> Column:
    wall = occurred_at if isinstance(dtype, T.TimestampNTZType) else to_wall(occurred_at)
    told = wall.cast("string")
    # Always six digits of a second.
    point = F.when(F.contains(told, F.lit(".")), F.lit("")).otherwise(".")
    time = F.rpad(F.concat(told, point), 26, "0")
    text = F.to_json(F.struct(time.alias("occurred_at"), entry_id.alias("id")))
    # base64() wraps long texts.
    return F.translate(F.base64(text.cast("binary")), "\r\n", "")


def page_meta(
    df: DataFrame, per_page: int | None = None, cursor: str | None = None, cap: int = COUNT_CAP
) -> DataFrame:
    """One row: has_next, next_cursor, per_page, count, has_next_count.

    The probe holds at most one row more than a page.
    """
    size = clamp_per_page(per_page)
    rest = after_cursor(df, cursor)
    probe = recent(rest.select("occurred_at", "id")).limit(size + 1)
    # Position `size` newest first is the last row of this page.
    ranked = F.sort_array(F.collect_list(F.struct("occurred_at", "id")), asc=False)
    last = F.get(ranked, size - 1).alias("last")
    peeked = probe.agg(F.count(F.lit(1)).alias("n"), last).select(
        (F.col("n") > size).alias("has_next"),
        F.when(
            F.col("n") > size,
            cursor_column(F.col("last.occurred_at"), F.col("last.id"), time_type(df)),
        ).alias("next_cursor"),
    )
    both = peeked.unionByName(capped_count(rest, cap), allowMissingColumns=True)
    return both.agg(
        F.max("has_next").alias("has_next"),
        F.max("next_cursor").alias("next_cursor"),
        F.lit(size).alias("per_page"),
        F.max("count").alias("count"),
        F.max("has_next_count").alias("has_next_count"),
    )
