"""Triage of a stored table: changes are logged, read along, and folded in now and then."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.ids import ulid_time
from logsluice.operators import filters
from logsluice.operators.triage import (
    GIVEN,
    Ids,
    apply_changes,
    clear_condition,
    delete_many,
    listed_rows,
    refusal,
    winning_changes,
    with_triage_columns,
)
from logsluice.session import drop_path, path_exists, scratch_path
from logsluice.sources.commits import live_rows
from logsluice.sources.entries import DAY, read_entries, rewrite_days

CHANGE_COLUMNS = ("id", "status", "changed_at", "changed_by", "note")
# Folded changes in more files than this are put together again.
MANY_FILES = 64


def record_changes(changes: DataFrame, log: str, overrides: dict | None = None) -> DataFrame:
    """Adds changes to the log, a table of its own; returns those refused, with a ``reason``.

    A change may leave out the status (only a note, say). Where the flag ``note_given``
    or ``by_given`` is true, a null note or changer is set, too: so a note is cleared.
    """
    flags = [
        (F.coalesce(F.col(flag), F.lit(False)) if flag in changes.columns else F.lit(False)).alias(flag)
        for flag in GIVEN.values()
    ]
    judged = changes.select(*CHANGE_COLUMNS, *flags).withColumn("reason", refusal(changes, overrides))
    judged.where("reason IS NULL").drop("reason").write.mode("append").parquet(log)
    return judged.where("reason IS NOT NULL")


def folded_path(log: str) -> str:
    """Where the log's changes are kept that a fold has written into the entries."""
    return f"{log.rstrip('/')}-folded"


def _part(spark: SparkSession, files: list[str]) -> DataFrame:
    """Changes of some files; parts written without the flags read as not given."""
    return spark.read.option("mergeSchema", "true").parquet(*files)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path_exists(spark, folder):
        return []
    paths = [s.getPath() for s in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]
    return sorted(p.toString() for p in paths if not p.getName().startswith(("_", ".")))


def _with_folded(spark: SparkSession, log: str, pending: DataFrame) -> DataFrame:
    """Changes with those folded before of the same entries, which a late change may be older than."""
    before = _files(spark, folded_path(log))
    if not before:
        return pending
    known = _part(spark, before).join(pending.select("id").distinct(), "id", "left_semi")
    return pending.unionByName(known, allowMissingColumns=True)


def read_changes(spark: SparkSession, log: str) -> DataFrame | None:
    """The changes that the entries do not have yet, and the folded ones of the same entries; ``None`` if there are none.

    Read this before the entries: what a fold takes from the log meanwhile is in the entries by then.
    """
    pending = _files(spark, log)
    return _with_folded(spark, log, _part(spark, pending)) if pending else None


def current_entries(
    spark: SparkSession,
    table: str,
    log: str,
    since: datetime | None = None,
    until: datetime | None = None,
    overrides: dict | None = None,
) -> DataFrame:
    """The stored entries as the change log has them now.

    The log holds what no fold has taken yet, so it is small, and below Spark's threshold
    entries are not shuffled for it.
    """
    changes = read_changes(spark, log)
    rows = read_entries(spark, table, since, until)
    return with_triage_columns(rows) if changes is None else apply_changes(rows, changes, overrides)


def find_stored(spark: SparkSession, table: str, entry_id: str, log: str | None = None) -> DataFrame:
    """The stored entry with this id, as the change log has it now; an empty frame when there is none.

    An id that tells its time is looked for on that day first, in one folder; any other id,
    and one that is not there, in the whole table, where files without it are skipped by
    their filters on ``id``.
    """
    changes = read_changes(spark, log) if log is not None else None
    moment = ulid_time(entry_id)
    stored = live_rows(spark, table)
    rows = stored.where(F.col("id") == entry_id)
    if moment is not None and DAY in stored.columns:
        near = rows.where(F.col(DAY) == F.lit(moment.date()))
        rows = rows if near.isEmpty() else near
    rows = rows.drop(DAY, "batch").limit(1)
    if changes is None:
        return rows if log is None else with_triage_columns(rows)
    return apply_changes(rows, changes.where(F.col("id") == entry_id))


def _days_of(spark: SparkSession, table: str, ids: Ids) -> list[date]:
    """The days that hold listed entries; no more than the table has folders."""
    stored = live_rows(spark, table).select("id", DAY)
    return [row[DAY] for row in listed_rows(stored, ids).select(DAY).distinct().collect()]


def fold_changes(
    spark: SparkSession, table: str, log: str, overrides: dict | None = None
) -> None:
    """Takes the change log into the table; only days with changed entries are rewritten.

    Of what is folded, the changes that set an entry's newest values are kept beside the log,
    at most three for an entry and fold, as a later change may come with an earlier time; all
    others go, and those that lost since go when there are ``MANY_FILES`` files. Another fold then has nothing to do. New files appear before old ones are
    removed and changes may be read twice without effect, so a fold that failed is run
    again. What is appended to the log meanwhile stays in it for the next fold.
    """
    pending = _files(spark, log)
    if not pending:
        return
    changes = _with_folded(spark, log, _part(spark, pending))
    missing = {"status_changed_at", "status_changed_by", "note"} - set(
        live_rows(spark, table).columns
    )
    if missing:
        # Days with more columns than others could not be read as one table.
        raise ValueError(f"the table lacks {sorted(missing)}; write it with conform()")
    days = _days_of(spark, table, changes.select("id"))
    rewrite_days(spark, table, days, lambda rows: apply_changes(rows, changes, overrides))
    folded = folded_path(log)
    before = _files(spark, folded)
    winning_changes(changes).write.mode("append").parquet(folded)
    _drop_files(spark, pending)
    if len(before) >= MANY_FILES:
        before = _files(spark, folded)
        winning_changes(_part(spark, before)).write.mode("append").parquet(folded)
        _drop_files(spark, before)


def _drop_files(spark: SparkSession, files: list[str]) -> None:
    for file in files:
        drop_path(spark, file)


def delete_stored(spark: SparkSession, table: str, ids: Ids) -> None:
    """Takes the listed entries off the table, rewriting only their days."""
    if not isinstance(ids, DataFrame):
        ids = list(ids)
    rewrite_days(spark, table, _days_of(spark, table, ids), lambda rows: delete_many(rows, ids))


def clear_stored(
    spark: SparkSession,
    table: str,
    log: str | None = None,
    levels: filters.Values = None,
    channels: filters.Values = None,
    statuses: filters.Values = None,
) -> None:
    """Deletes the matching entries from the table, by their status as the change log has it now."""
    rows = current_entries(spark, table, log) if log else read_entries(spark, table)
    ids = scratch_path(spark, "cleared")
    rows.where(clear_condition(levels, channels, statuses)).select("id").write.parquet(ids)
    delete_stored(spark, table, spark.read.parquet(ids))
    drop_path(spark, ids)
