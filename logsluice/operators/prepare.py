"""From a captured record to a row that can be stored."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.functions.ids import ulid
from logsluice.functions.text import head_bytes, preview
from logsluice.schema import (
    ENTRY_SCHEMA,
    Limits,
    epoch_micros,
    instant,
    time_type,
    to_second,
)


def truncate_message(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Messages over ``truncate_at`` bytes are cut; over ``message_inline`` only flagged."""
    size = F.octet_length("message")
    return df.withColumns(
        {
            "message": F.when(
                size > limits.truncate_at, head_bytes(F.col("message"), limits.truncate_at)
            ).otherwise(F.col("message")),
            "is_truncated": F.coalesce(_flag(df), F.lit(False))
            | F.coalesce(size > min(limits.message_inline, limits.truncate_at), F.lit(False)),
        }
    )


def cap_context(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A context over ``truncate_at`` bytes is replaced by a note of its size."""
    size = F.octet_length("context")
    note = F.to_json(
        F.struct(F.lit(True).alias("_truncated"), size.alias("_original_size"))
    )
    return df.withColumns(
        {
            "context": F.when(size > limits.truncate_at, note).otherwise(F.col("context")),
            "is_truncated": F.coalesce(_flag(df), F.lit(False))
            | F.coalesce(size > limits.truncate_at, F.lit(False)),
        }
    )


def _flag(df: DataFrame) -> Column:
    return F.col("is_truncated") if "is_truncated" in df.columns else F.lit(False)


def _column_or_null(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def fill_defaults(df: DataFrame, now: datetime) -> DataFrame:
    """Missing time and status filled in; all times at second precision."""
    dtype = df.schema["occurred_at"].dataType if "occurred_at" in df.columns else T.TimestampType()
    moment = instant(now, dtype)

    return df.withColumns(
        {
            "occurred_at": to_second(
                F.coalesce(_column_or_null(df, "occurred_at", dtype), moment), dtype
            ),
            "status": F.coalesce(_column_or_null(df, "status", T.StringType()), F.lit("open")),
            "created_at": to_second(moment, dtype),
        }
    )


def with_ulid(
    df: DataFrame, ts_col: str = "occurred_at", key_cols: Sequence[str] = ()
) -> DataFrame:
    """``id`` from the row's time and the given columns, which must tell rows apart;
    without any, from the time and chance."""
    millis = F.floor(epoch_micros(F.col(ts_col), time_type(df, ts_col)) / 1000)
    return df.withColumn("id", ulid(millis, [F.col(c) for c in key_cols]))


def add_previews(df: DataFrame, limits: Limits = Limits(), unit: str = "bytes") -> DataFrame:
    """Previews are taken from the texts as they came, before any cut."""
    return df.withColumns(
        {
            "message_preview": preview(F.col("message"), limits.message_preview, unit),
            "context_preview": preview(
                _column_or_null(df, "context", T.StringType()), limits.context_preview, unit
            ),
        }
    )


def prepare_entries(
    df: DataFrame,
    now: datetime,
    limits: Limits = Limits(),
    key_cols: Sequence[str] | None = None,
    unit: str = "bytes",
) -> DataFrame:
    """Previews, cuts, defaults and id. Projections only, no shuffle.

    Rows keep an ``id`` they already have unless ``key_cols`` asks for a new one.
    """
    rows = add_previews(df, limits, unit)
    rows = truncate_message(rows, limits)
    if "context" in rows.columns:
        rows = cap_context(rows, limits)
    rows = fill_defaults(rows, now)
    if key_cols or "id" not in rows.columns:
        rows = with_ulid(rows, "occurred_at", key_cols or ())
    return rows


def conform(df: DataFrame, schema: T.StructType = ENTRY_SCHEMA) -> DataFrame:
    """The entry table's columns in order. Missing ones are null, the flag false.

    Missing times get the type of the times that are there.
    """
    columns = []
    time = time_type(df) if "occurred_at" in df.columns else T.TimestampType()
    for field in schema:
        if field.name not in df.columns:
            default = F.lit(False) if field.name == "is_truncated" else F.lit(None)
            dtype = time if isinstance(field.dataType, T.TimestampType) else field.dataType
            columns.append(default.cast(dtype).alias(field.name))
        elif field.name == "is_truncated":
            columns.append(F.coalesce(F.col(field.name), F.lit(False)).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def union_conformed(*frames: DataFrame) -> DataFrame:
    """Rows of different shapes brought to one set of columns."""
    return conform(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
