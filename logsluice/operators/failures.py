"""Failed writes kept visible as data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.functions.text import cut_chars
from logsluice.schema import MAX_CHARS, as_utc, epoch_micros, instant

FAILURE_KEY = ("class", "file", "line")
FAILURE_MARK = "_write_failure"
EVERY = 100
# Characters kept of an exception text in a row and in a summary.
ROW_TEXT = 1000
SUMMARY_TEXT = 500
# SQLSTATE classes that a retry may cure.
RETRYABLE = ("08", "40")

# Occurrences of one key are numbered slice by slice, so that a key with very
# many rows is spread over as many tasks as it has slices.
SLICE_SECONDS = 60
_BEFORE_ALL = -(2**63)
# A slice of more rows is split by quantiles of its order, into parts of about
# this many rows; a split looks through at most about this many bounds.
HOT_ROWS = 50_000
MOST_BOUNDS = 256
# Slices of one TTL each that one task looks through for pauses.
STRETCH = 10_000


def occurrences(
    df: DataFrame,
    key: Sequence[str] = FAILURE_KEY,
    order: Sequence[str] = ("at",),
    scope: Sequence[str] = (),
    slice_seconds: int = SLICE_SECONDS,
    before: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``occurrence``: the row's running number within its key.

    ``order[0]`` is a timestamp; the others make the order total. Counting
    restarts in each ``scope``. Rows are counted per key and time slice first
    (combined before the shuffle); the exclusive running sum over the slices,
    one row each, says where a slice starts. A slice of more than ``hot_rows`` rows, many
    failures of one instant say, is split at quantiles of the whole order, so that
    the parts keep the order and none is hot. ``before`` holds earlier counts
    per key as ``(key..., n)``.
    """
    micros = epoch_micros(F.col(order[0]), df.schema[order[0]].dataType)
    # A struct compares and hashes null fields like any other value, so the
    # join is null-safe and the window can reuse its partitioning.
    whole_key = F.struct(*scope, *key)
    sliced = df.withColumns(
        {
            "_key": whole_key,
            "_slice": F.coalesce(F.floor(micros / (slice_seconds * 1_000_000)), F.lit(0)).cast("bigint"),
        }
    )
    sliced = _split_hot(sliced, order, hot_rows)
    counts = sliced.groupBy("_key", "_slice", "_part").agg(F.count(F.lit(1)).alias("_n"))
    if before is not None:
        counts = counts.unionByName(
            before.select(
                whole_key.alias("_key"),
                F.lit(_BEFORE_ALL).alias("_slice"),
                F.lit(0).alias("_part"),
                F.col("n").alias("_n"),
            )
        )
    earlier = Window.partitionBy("_key").orderBy("_slice", "_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        "_key", "_slice", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    in_part = Window.partitionBy("_key", "_slice", "_part").orderBy(*order)
    return (
        sliced.join(starts, ["_key", "_slice", "_part"])
        .withColumn("occurrence", F.col("_start") + F.row_number().over(in_part))
        .select(*df.columns, "occurrence")
    )


def _split_hot(sliced: DataFrame, order: Sequence[str], hot_rows: int) -> DataFrame:
    """Adds ``_part``: 0, or in a slice of more than ``hot_rows`` rows how many bounds a row has reached.

    Bounds are places in the order, drawn by their hash at a rate that gives parts of
    about half of ``hot_rows`` rows, and at most about ``MOST_BOUNDS`` of them. Equal rows
    reach the same bounds and so does a row that is read again.
    """
    place = F.struct(*order)
    sizes = sliced.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > hot_rows)
    draw = F.shiftrightunsigned(F.xxhash64(*order), 11) / F.lit(float(2**53))
    rate = F.least(F.lit(2.0 / hot_rows), F.lit(float(MOST_BOUNDS)) / F.col("_rows"))
    bounds = (
        sliced.join(hot, ["_key", "_slice"])
        .where(draw < rate)
        .groupBy("_key", "_slice")
        .agg(F.collect_set(place).alias("_bounds"))
    )
    reached = F.size(F.filter("_bounds", lambda bound: bound <= place))
    return (
        sliced.join(bounds, ["_key", "_slice"], "left")
        .withColumn("_part", F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(reached))
        .drop("_bounds")
    )


def keep_beat(occurrence: Column, every: int = EVERY) -> Column:
    return (occurrence == 1) | (occurrence % every == 0)


def heartbeat(
    df: DataFrame,
    key: Sequence[str] = FAILURE_KEY,
    order: Sequence[str] = ("at",),
    every: int = EVERY,
    scope: Sequence[str] = (),
    **options,
) -> DataFrame:
    """The first occurrence of each key and every ``every``-th after it."""
    numbered = occurrences(df, key, order, scope, **options)
    return numbered.where(keep_beat(F.col("occurrence"), every))


def fallback_rows(
    failures: DataFrame,
    where: str,
    now: datetime,
    order: Sequence[str] = ("at",),
    every: int = EVERY,
    key: Sequence[str] = FAILURE_KEY,
    scope: Sequence[str] = (),
    mark: str = FAILURE_MARK,
) -> DataFrame:
    """Minimal entries standing for writes that failed, thinned to a heartbeat.

    Level, message, channel and request details are kept; the context is
    replaced by a description of the failure, the source is dropped.
    """
    beats = heartbeat(failures, key, order, every, scope)

    def kept(name: str, default: Column | None = None) -> Column:
        column = F.col(name) if name in failures.columns else F.lit(None).cast("string")
        return (column if default is None else F.coalesce(column, default)).alias(name)

    at_type = failures.schema["occurred_at"].dataType if "occurred_at" in failures.columns else None
    told = F.struct(
        F.col("class").alias("exception_class"),
        cut_chars(F.col("error"), ROW_TEXT).alias("exception_message"),
        F.lit(where).alias("where"),
        F.col("occurrence"),
    )
    return beats.select(
        kept("level", F.lit("error")),
        kept("message", F.lit("(unknown message)")),
        kept("channel"),
        kept("trace_id"),
        kept("user_id"),
        kept("ip_address"),
        kept("user_agent"),
        kept("http_method"),
        kept("url"),
        (
            F.coalesce(F.col("occurred_at"), instant(now, at_type))
            if at_type is not None
            else instant(now)
        ).alias("occurred_at"),
        F.to_json(F.struct(told.alias(mark))).alias("context"),
    )


def rejection_reason(df: DataFrame, widths: bool = True) -> Column:
    """Why a row cannot be stored; null when it can.

    ``widths`` also holds texts against what a database column takes. Files take any
    width, so the tables here are written without that.
    """
    reason = F.lit(None).cast("string")
    for name, size in MAX_CHARS.items():
        if widths and name in df.columns:
            reason = F.when(
                F.length(F.col(name)) > size, F.lit(f"{name} is longer than {size} characters")
            ).otherwise(reason)
    for name in ("message", "level"):
        missing = F.col(name).isNull() if name in df.columns else F.lit(True)
        reason = F.when(missing, F.lit(f"{name} is missing")).otherwise(reason)
    return reason


def split_valid(df: DataFrame, widths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the others with their ``reason``."""
    judged = df.withColumn("reason", rejection_reason(df, widths))
    good = judged.where(F.col("reason").isNull()).drop("reason")
    return good, judged.where(F.col("reason").isNotNull())


def as_failures(bad: DataFrame, where: str, now: datetime) -> DataFrame:
    """Rejected rows in the shape of failures: one key per reason."""
    at = F.lit(as_utc(now))
    if "occurred_at" in bad.columns:
        at = F.coalesce(F.col("occurred_at"), instant(now, bad.schema["occurred_at"].dataType))
    return bad.withColumns(
        {
            "class": F.lit("InvalidEntry"),
            "file": F.lit(where),
            "line": F.lit(0),
            "error": F.col("reason"),
            "at": at,
        }
    )


def is_retryable(code: Column) -> Column:
    return F.coalesce(F.substring(code, 1, 2).isin(*RETRYABLE), F.lit(False))


def split_retryable(failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures worth a retry, and those to keep as fallback rows."""
    again = is_retryable(F.col("code"))
    return failures.where(again), failures.where(~again)


def failure_counts(failures: DataFrame, key: Sequence[str] = FAILURE_KEY) -> DataFrame:
    return failures.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))


def failure_summary(failures: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    """One row on all failures, or none when there are none."""
    last = F.max(F.struct(*order, "class", "error", "where")).alias("last")
    return (
        failures.agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first_at"), last)
        .where(F.col("count") > 0)
        .select(
            "count",
            "first_at",
            F.col("last.class").alias("last_class"),
            cut_chars(F.col("last.error"), SUMMARY_TEXT).alias("last_message"),
            F.col("last.where").alias("last_where"),
            F.col("last.at").alias("last_at"),
        )
    )


def failures_since_dismiss(
    failures: DataFrame,
    dismissed_at: datetime | None = None,
    ttl_seconds: int | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Failures after the last dismissal that have not lapsed.

    With a TTL the memory of failures lapses once none comes for that long; so
    only the last run without a longer pause counts, and only if it reaches
    ``now``. Pauses are found between slices of one TTL each, since rows in
    the same slice are closer together than that.
    """
    dtype = failures.schema["at"].dataType
    rest = failures
    if dismissed_at is not None:
        rest = rest.where(F.col("at") > instant(dismissed_at, dtype))
    if not ttl_seconds:
        return rest
    if now is None:
        raise ValueError("a ttl needs now=")
    rest = rest.where(F.col("at") <= instant(now, dtype))
    seconds = epoch_micros(F.col("at"), dtype) / 1_000_000
    slices = rest.groupBy(F.floor(seconds / ttl_seconds).alias("slice")).agg(
        F.min(seconds).alias("low"), F.max(seconds).alias("high")
    )
    # Neighbours are found inside stretches of slices; only each stretch's ends, one row,
    # meet in one place.
    stretch = F.floor(F.col("slice") / STRETCH)
    slices = slices.withColumn("stretch", stretch)
    ends = slices.groupBy("stretch").agg(F.max("high").alias("end"))
    over_all = Window.partitionBy(F.lit(1)).orderBy("stretch")
    ends = ends.select("stretch", F.lag("end").over(over_all).alias("before"))
    in_time = Window.partitionBy("stretch").orderBy("slice")
    last = F.coalesce(F.lag("high").over(in_time), F.col("before"))
    pauses = slices.join(ends, "stretch").withColumn("pause", F.col("low") - last)
    run_start = F.max(F.when(F.coalesce(F.col("pause") > ttl_seconds, F.lit(True)), F.col("low")))
    live_from = F.lit((as_utc(now) - timedelta(seconds=ttl_seconds)).timestamp())
    start = pauses.agg(
        F.when(F.max("high") > live_from, run_start).alias("start")
    )
    return rest.where(seconds >= start.scalar())
