"""Predicates over log entries. Each returns a Column; blank arguments give TRUE,
which Catalyst folds away. Equality, IN, prefix and range forms reach the
Parquet scan as pushed filters."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable
from datetime import datetime
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.bounds import resolve_range
from logsluice.functions.context import INTERNAL_MARK
from logsluice.functions.text import contains_text
from logsluice.operators.search import search, search_text, simple_search
from logsluice.operators.status import status_rows
from logsluice.schema import LEVELS, instant, time_type

Values = str | Enum | Iterable[str | Enum] | None

# The ready-made filters.
QUICK_FILTERS = {
    "Today": {"from_": "today"},
    "This Hour": {"from_": "-1 hour"},
    "Last 24 Hours": {"from_": "-24 hours"},
    "Recent Errors": {
        "levels": ("error", "critical", "alert", "emergency"),
        "from_": "-24 hours",
    },
}

# How a runtime deprecation message reads.
DEPRECATION_PHRASE = "is deprecated"
DEPRECATION_END = r" on line \d+$"

_UUID = re.compile(
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32}", re.IGNORECASE
)


def _list(values: Values) -> list[str]:
    if values is None:
        return []
    if isinstance(values, (str, Enum)):
        values = [values]
    return [str(v.value) if isinstance(v, Enum) else str(v) for v in values]


def _one_of(column: str, values: Values) -> Column:
    wanted = _list(values)
    return F.col(column).isin(wanted) if wanted else F.lit(True)


def _none_of(column: str, values: Values) -> Column:
    unwanted = _list(values)
    if not unwanted:
        return F.lit(True)
    return F.col(column).isNull() | ~F.col(column).isin(unwanted)


def level(values: Values) -> Column:
    return _one_of("level", values)


def exclude_level(values: Values) -> Column:
    unwanted = _list(values)
    return ~F.col("level").isin(unwanted) if unwanted else F.lit(True)


def channel(values: Values) -> Column:
    return _one_of("channel", values)


def exclude_channel(values: Values) -> Column:
    """Rows without a channel stay."""
    return _none_of("channel", values)


def http_method(values: Values) -> Column:
    return _one_of("http_method", values)


def exclude_http_method(values: Values) -> Column:
    """Rows without a method stay."""
    return _none_of("http_method", values)


def status(values: Values) -> Column:
    return _one_of("status", values)


def is_open() -> Column:
    return F.col("status") == "open"


def needs_attention(overrides: dict | None = None) -> Column:
    """Statuses that are not closed, custom ones included."""
    return F.col("status").isin([s[0] for s in status_rows(overrides) if not s[3]])


def closed(overrides: dict | None = None) -> Column:
    return F.col("status").isin([s[0] for s in status_rows(overrides) if s[3]])


def date_range(
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    tz: str = "UTC",
    now: datetime | None = None,
    dtype: T.DataType | None = None,
) -> Column:
    """Both ends included; unreadable dates raise ``ValueError``."""
    low, high = resolve_range(from_, to, tz, now)
    parts = []
    if low is not None:
        parts.append(F.col("occurred_at") >= instant(low, dtype))
    if high is not None:
        parts.append(F.col("occurred_at") <= instant(high, dtype))
    return reduce(and_, parts) if parts else F.lit(True)


def trace_id(value: str | None) -> Column:
    """A whole id is compared, anything shorter is taken as its beginning."""
    value = (value or "").strip()
    if not value:
        return F.lit(True)
    if _UUID.fullmatch(value):
        return F.col("trace_id") == value
    return F.startswith(F.col("trace_id"), F.lit(value))


def user_id(value: str | int | None) -> Column:
    value = "" if value is None else str(value).strip()
    if not value:
        return F.lit(True)
    if value.isascii() and value.isdigit():
        # No stored number is as large as one that does not fit.
        return F.col("user_id") == int(value) if int(value) < 2**63 else F.lit(False) & F.col("user_id").isNotNull()
    return F.startswith(F.col("user_id").cast("string"), F.lit(value))


def ip_address(value: str | None) -> Column:
    value = (value or "").strip()
    if not value:
        return F.lit(True)
    try:
        ipaddress.ip_address(value)
    except ValueError:
        return F.startswith(F.col("ip_address"), F.lit(value))
    return F.col("ip_address") == value


def url(value: str | None) -> Column:
    return contains_text(F.col("url"), value) if value else F.lit(True)


def truncated() -> Column:
    return F.col("is_truncated")


def min_level(lowest: str) -> Column:
    """Levels at least as severe as ``lowest``."""
    return F.col("level").isin(list(LEVELS[LEVELS.index(lowest) :]))


def not_internal(mark: str = INTERNAL_MARK) -> Column:
    """The context does not carry the mark; what the message says never counts."""
    return F.get_json_object(F.col("context"), f"$.{mark}").isNull()


def not_deprecation(channels: Iterable[str] = ("deprecations",)) -> Column:
    """Neither from a deprecation channel nor worded as a runtime deprecation."""
    listed = F.coalesce(F.col("channel").isin(list(channels)), F.lit(False))
    message = F.coalesce(F.col("message"), F.lit(""))
    worded = F.contains(message, F.lit(DEPRECATION_PHRASE)) & message.rlike(DEPRECATION_END)
    return ~(listed | worded)


def has_channel() -> Column:
    return F.col("channel").isNotNull()


def drop_internal(df: DataFrame, mark: str = INTERNAL_MARK) -> DataFrame:
    return df.where(not_internal(mark))


def drop_deprecations(
    df: DataFrame, channels: Iterable[str] = ("deprecations",), enabled: bool = True
) -> DataFrame:
    return df.where(not_deprecation(channels)) if enabled else df


def drop_null_channel(df: DataFrame, enabled: bool = False) -> DataFrame:
    return df.where(has_channel()) if enabled else df


def filter_condition(
    df: DataFrame,
    *,
    statuses: Values = None,
    levels: Values = None,
    exclude_levels: Values = None,
    channels: Values = None,
    exclude_channels: Values = None,
    searches: Iterable[dict] | None = None,
    search_for: str | None = None,
    regex: bool = False,
    search_syntax: bool = True,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    tz: str = "UTC",
    now: datetime | None = None,
    trace: str | None = None,
    user: str | int | None = None,
    ip: str | None = None,
    methods: Values = None,
    exclude_methods: Values = None,
    url_part: str | None = None,
    all_statuses: bool = False,
) -> Column:
    """Everything a listing can be narrowed by, ANDed.

    Without ``statuses`` only open entries count, unless ``all_statuses``.
    """
    if _list(statuses):
        by_status = status(statuses)
    else:
        by_status = F.lit(True) if all_statuses else is_open()
    text = F.lit(True)
    if searches:
        text = search(searches, regex=regex, search_syntax=search_syntax)
    elif search_for:
        text = search_text(search_for, regex=regex) if search_syntax else simple_search(search_for)
    # Cheap, pushable predicates first; text comparison last.
    return reduce(
        and_,
        [
            date_range(from_, to, tz, now, time_type(df)),
            by_status,
            level(levels),
            exclude_level(exclude_levels),
            channel(channels),
            exclude_channel(exclude_channels),
            trace_id(trace),
            user_id(user),
            ip_address(ip),
            http_method(methods),
            exclude_http_method(exclude_methods),
            url(url_part),
            text,
        ],
    )


def apply_filters(df: DataFrame, **params) -> DataFrame:
    """One ``where`` with all of :func:`filter_condition`."""
    return df.where(filter_condition(df, **params))


def quick_filter(
    df: DataFrame, name: str, now: datetime, tz: str = "UTC", presets: dict | None = None
) -> DataFrame:
    """A named preset of levels, statuses and time."""
    presets = {**QUICK_FILTERS, **(presets or {})}
    if name not in presets:
        raise ValueError(f"unknown quick filter: {name!r}")
    return apply_filters(df, now=now, tz=tz, **presets[name])


def pivot(
    df: DataFrame,
    field: str,
    value: str | int,
    keep_range: tuple[str | datetime | None, str | datetime | None] = (None, None),
    tz: str = "UTC",
    now: datetime | None = None,
    all_statuses: bool = False,
) -> DataFrame:
    """Only the date range stays, then one trace, user or ip is followed."""
    names = {"trace_id": "trace", "user_id": "user", "ip_address": "ip"}
    if field not in names:
        raise ValueError(f"cannot pivot on {field!r}")
    return apply_filters(
        df,
        from_=keep_range[0],
        to=keep_range[1],
        tz=tz,
        now=now,
        all_statuses=all_statuses,
        **{names[field]: value},
    )


def by_status_class(df: DataFrame, dimension: DataFrame, want_closed: bool) -> DataFrame:
    """Entries whose status the dimension calls closed (or not closed)."""
    wanted = dimension.where(F.col("closed") == want_closed).select(F.col("value").alias("status"))
    return df.join(wanted, "status", "left_semi")
