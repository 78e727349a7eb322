"""The entry table on disk: Parquet, partitioned by day, sorted by time inside."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.operators.failures import as_failures, fallback_rows, split_valid
from logsluice.operators.prepare import conform, prepare_entries
from logsluice.schema import as_utc, instant, time_type
from logsluice.session import drop_path
from logsluice.sources.commits import LOG, commit, files_below, live_rows, new_folder, read_log, settle

DAY = "date"
# Columns looked up by whole values; bloom filters let readers skip row groups.
_DAY_FOLDER = re.compile(rf"{DAY}=\d{{4}}-\d\d-\d\d")
LOOKUP_COLUMNS = ("trace_id", "ip_address", "user_id", "id")


def read_entries(
    spark: SparkSession,
    path: str,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """The table, narrowed to a time range by whole days first (partition
    pruning), then exactly (pushed to the Parquet row groups)."""
    df = live_rows(spark, path)
    dtype = time_type(df)
    partitioned = DAY in df.columns
    if since is not None:
        if partitioned:
            df = df.where(F.col(DAY) >= F.lit(as_utc(since).date()))
        df = df.where(F.col("occurred_at") >= instant(since, dtype))
    if until is not None:
        if partitioned:
            df = df.where(F.col(DAY) <= F.lit(as_utc(until).date()))
        df = df.where(F.col("occurred_at") <= instant(until, dtype))
    return df.drop(DAY, "batch")


def jdbc_options(url: str, table: str, since: datetime, until: datetime, parts: int) -> dict:
    """Options that read a database table in ``parts`` time slices."""
    form = "%Y-%m-%d %H:%M:%S"
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "occurred_at",
        "lowerBound": as_utc(since).strftime(form),
        "upperBound": as_utc(until).strftime(form),
        "numPartitions": str(parts),
    }


def read_entries_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    since: datetime,
    until: datetime,
    parts: int = 64,
    **options: str,
) -> DataFrame:
    """The table as a relational database holds it; the driver jar is the caller's."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, since, until, parts))
    return reader.options(**options).load()


def utc_day(df: DataFrame) -> Column:
    """The UTC day, whatever time zone the session shows times in."""
    if isinstance(time_type(df), T.TimestampNTZType):
        return F.to_date("occurred_at")
    return F.date_from_unix_date(F.floor(F.unix_seconds("occurred_at") / 86_400).cast("int"))


def entry_writer(rows: DataFrame) -> DataFrameWriter:
    """A writer of entry files with bloom filters as big as the values need."""
    writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def write_entries(
    df: DataFrame,
    path: str,
    mode: str = "append",
    batch: int | str | None = None,
    rebalance: bool = True,
) -> None:
    """Writes conformed rows by UTC day.

    ``rebalance`` lets AQE gather the rows of a day into even files and split a
    day that is too big. With ``batch`` the rows go to their own sub-partition,
    which a replay of the same batch overwrites instead of adding to.
    """
    rows = df.withColumn(DAY, utc_day(df))
    by = [DAY]
    if batch is not None:
        rows = rows.withColumn("batch", F.lit(batch))
        by.append("batch")
    if rebalance:
        rows = rows.hint("rebalance", DAY)
    rows = rows.sortWithinPartitions(DAY, "occurred_at", "id")
    writer = entry_writer(rows).partitionBy(*by)
    writer = writer.mode("overwrite" if batch is not None else mode)
    if batch is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stored_days(spark: SparkSession, path: str) -> dict[date, str]:
    """The table's days and their folders, from one folder listing.

    What was committed and not carried out yet is carried out first, so that every day has its folder.
    """
    settle(spark, path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and _DAY_FOLDER.fullmatch(name):
            days[date.fromisoformat(name.removeprefix(f"{DAY}="))] = status.getPath().toString()
    return days


def rewrite_days(
    spark: SparkSession,
    path: str,
    days: Iterable[date],
    change: Callable[[DataFrame], DataFrame],
    drop: Iterable[date] = (),
) -> None:
    """Replaces the rows of some days by what ``change`` makes of them, and drops other days whole.

    The new rows are written once, beside the table, and come in with one rename
    (:mod:`logsluice.sources.commits`): readers see all changes or none. A crash before
    that changes nothing, one after it loses nothing. Rows appended meanwhile stay. Of two
    rewrites at the same time one fails with ``ConcurrentRewrite`` and can be run again.
    """
    settle(spark, path)
    version, _ = read_log(spark, path)
    folders = stored_days(spark, path)
    changed = {f for day in sorted(days) if day in folders for f in files_below(spark, folders[day])}
    gone = {f for day in sorted(drop) if day in folders for f in files_below(spark, folders[day])}
    if not changed and not gone:
        return
    folder = new_folder()
    if changed:
        rows = live_rows(spark, path, only=sorted(changed))
        parts = [c for c in (DAY, "batch") if c in rows.columns]
        made = change(rows).hint("rebalance", *parts).sortWithinPartitions(*parts, "occurred_at", "id")
        entry_writer(made).partitionBy(*parts).parquet(f"{path}/{LOG}/{folder}")
    commit(spark, path, version, folder, sorted(changed | gone))
    settle(spark, path)


def compact_days(spark: SparkSession, path: str, days: Iterable[date]) -> None:
    """Merges the batch folders of some days into one folder each.

    For days that no running stream will replay a micro-batch into.
    """
    if "batch" in live_rows(spark, path).columns:
        rewrite_days(spark, path, days, lambda rows: rows.withColumn("batch", F.lit("compact")))


def storable(good: DataFrame, bad: DataFrame, now: datetime, where: str = "append") -> DataFrame:
    """Valid rows prepared for the table, and fallback rows for the others."""
    prepared = conform(prepare_entries(good, now))
    failures = as_failures(bad, where, now)
    # A total order, so that a retry numbers the rows alike.
    told = F.xxhash64(*(c for c in bad.columns if not isinstance(bad.schema[c].dataType, T.MapType)))
    failures = failures.withColumn("_told", told)
    order = ["at", "level", "message", "_told"]
    failed = fallback_rows(failures, where, now, order, key=("class", "error"))
    fallback = prepare_entries(failed, now, key_cols=failed.columns)
    return prepared.unionByName(conform(fallback))


def append_entries(
    df: DataFrame,
    path: str,
    now: datetime,
    where: str = "append",
    batch: int | str | None = None,
    rebalance: bool = True,
    rejects: str | None = None,
) -> None:
    """Stores the rows; one that cannot be stored stops no other.

    Every such row is kept as it came, with its ``reason``, in a table of its own:
    ``rejects``, by default beside the entries. Only which of them also show up as
    entries is thinned. The table is by batch, so a replay replaces its part.
    """
    spark = df.sparkSession
    good, bad = split_valid(df, widths=False)
    part = f"{rejects or rejects_path(path)}/batch={batch if batch is not None else uuid.uuid4().hex}"
    bad.withColumn("rejected_at", F.lit(as_utc(now))).write.mode("overwrite").parquet(part)
    kept = spark.read.schema(bad.schema).parquet(part)
    write_entries(storable(good, kept, now, where), path, batch=batch, rebalance=rebalance)
    if kept.isEmpty():
        drop_path(spark, part)


def rejects_path(path: str) -> str:
    """Where the rows go that could not be stored in the table at ``path``."""
    return f"{path.rstrip('/')}-rejected"
