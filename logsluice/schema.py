"""The entry table: column types, limits and the fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Syslog levels from the least to the most severe.
LEVELS = ("debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")

# Value, label, colour, closed.
BUILT_IN_STATUSES = (
    ("open", "Open", "gray", False),
    ("investigating", "Investigating", "yellow", False),
    ("resolved", "Resolved", "green", True),
    ("ignored", "Ignored", "slate", True),
)

# The columns of an entry, those of a listing, and the sizes at which texts are cut.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("message_preview", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("context_preview", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_line", T.IntegerType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("occurred_at", T.TimestampType(), False),
        T.StructField("is_truncated", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("status_changed_at", T.TimestampType()),
        T.StructField("status_changed_by", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

# Widest text each column stores, in characters.
MAX_CHARS = {
    "level": 20,
    "channel": 100,
    "source": 500,
    "trace_id": 36,
    "ip_address": 45,
    "user_agent": 500,
    "http_method": 10,
    "url": 2000,
    "status": 20,
    "status_changed_by": 255,
}

MAX_NOTE_CHARS = 10_000

LIST_COLUMNS = (
    "id",
    "level",
    "message_preview",
    "context_preview",
    "channel",
    "source",
    "source_line",
    "occurred_at",
    "status",
    "trace_id",
    "user_id",
    "ip_address",
    "http_method",
    "url",
    "is_truncated",
)


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes at which stored text is previewed, flagged or cut."""

    message_preview: int = 500
    context_preview: int = 500
    message_inline: int = 16_000
    truncate_at: int = 1_000_000


def as_utc(moment: datetime) -> datetime:
    """A naive datetime is taken as UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: datetime, dtype: T.DataType | None = None) -> Column:
    """A literal of the column's own timestamp type.

    Comparing TIMESTAMP_NTZ with TIMESTAMP would put a cast on the column and
    keep the predicate away from the Parquet scan, so the literal adapts.
    """
    utc = as_utc(moment)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(utc)


def time_type(df: DataFrame, column: str = "occurred_at") -> T.DataType:
    return df.schema[column].dataType


# The helpers below never go through the session's time zone: a TIMESTAMP_NTZ
# is UTC wall-clock time here, whatever zone a session displays.


def epoch_micros(moment: Column, dtype: T.DataType) -> Column:
    if not isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(moment)
    seconds = F.extract(F.lit("SECOND"), moment)
    minutes = (F.unix_date(F.to_date(moment)).cast("bigint") * 24 + F.hour(moment)) * 60
    whole = (minutes + F.minute(moment)) * 60_000_000
    return whole + (seconds * 1_000_000).cast("bigint")


def to_instant(moment: Column) -> Column:
    """TIMESTAMP_NTZ in UTC as TIMESTAMP."""
    return F.timestamp_micros(epoch_micros(moment, T.TimestampNTZType()))


def to_wall(moment: Column) -> Column:
    """TIMESTAMP as TIMESTAMP_NTZ in UTC."""
    seconds = (F.unix_micros(moment).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def to_second(moment: Column, dtype: T.DataType) -> Column:
    """Without the fraction of a second."""
    if not isinstance(dtype, T.TimestampNTZType):
        return F.date_trunc("second", moment)
    fraction = (F.extract(F.lit("SECOND"), moment) % 1).cast("decimal(18,6)")
    return moment - F.make_dt_interval(secs=fraction)
