"""Status, notes and deletes. Stored rows never change in place: each operator
gives the frame as it is afterwards, or folds a change log into it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.operators import filters
from logsluice.operators.status import check_status, status_rows
from logsluice.schema import MAX_NOTE_CHARS, instant

Ids = Iterable[str] | DataFrame


def check_note(note: str | None) -> str | None:
    if note is not None and len(note) > MAX_NOTE_CHARS:
        raise ValueError(f"a note may have {MAX_NOTE_CHARS} characters at most")
    return note


def with_triage_columns(df: DataFrame) -> DataFrame:
    """Adds the triage columns that are missing, as nulls."""
    wanted = {
        "status_changed_at": df.schema["occurred_at"].dataType
        if "occurred_at" in df.columns
        else T.TimestampType(),
        "status_changed_by": T.StringType(),
        "note": T.StringType(),
    }
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _ids_frame(df: DataFrame, ids: Ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select("id").distinct()
    return df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")


def _flag_ids(df: DataFrame, ids: Ids, flag: str) -> DataFrame:
    """Adds whether the row's id is listed. Spark broadcasts the id frame only
    when its measured size is below the session's threshold."""
    listed = _ids_frame(df, ids).withColumn(flag, F.lit(True))
    return df.join(listed, "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def set_status(
    df: DataFrame,
    entry_id: str,
    status: str,
    now: datetime,
    by: str | None = None,
    note: str | None = None,
    overrides: dict | None = None,
) -> DataFrame:
    """One entry's status and its time; who and note change only when given."""
    check_status(status, overrides)
    check_note(note)
    df = with_triage_columns(df)
    hit = F.col("id") == entry_id
    new = {
        "status": F.lit(status),
        "status_changed_at": instant(now, df.schema["status_changed_at"].dataType),
    }
    if by is not None:
        new["status_changed_by"] = F.lit(by)
    if note is not None:
        new["note"] = F.lit(note)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


# Columns of a change that may set a value to null: where the flag is true the value counts as given.
GIVEN = {"changed_by": "by_given", "note": "note_given"}


def refusal(changes: DataFrame, overrides: dict | None = None) -> Column:
    """Why a change cannot be made; null when it can. A change without a status is one of the others' values."""
    known = [s[0] for s in status_rows(overrides)]
    return (
        F.when(F.col("id").isNull(), F.lit("id is missing"))
        .when(F.col("changed_at").isNull(), F.lit("changed_at is missing"))
        .when(~F.col("status").isin(known), F.lit("status is unknown"))
        .when(F.length("note") > MAX_NOTE_CHARS, F.lit(f"note is longer than {MAX_NOTE_CHARS} characters"))
    )


def _when_given(changes: DataFrame, column: str) -> Column:
    """The place of a change in the order of changes, null where it gives the column no value."""
    given = F.col(column).isNotNull()
    if GIVEN.get(column) in changes.columns:
        given = given | F.coalesce(F.col(GIVEN[column]), F.lit(False))
    return F.when(given, F.struct("changed_at", "status", "changed_by", "note"))


def winning_changes(changes: DataFrame) -> DataFrame:
    """The changes, whole, that set each entry's newest values: at most three for an id.

    With any further changes they give what all changes together would.
    """
    whole = F.struct(*changes.columns)
    winners = changes.groupBy("id").agg(
        F.array_distinct(
            F.array_compact(
                F.array(*(F.max_by(whole, _when_given(changes, c)) for c in ("status", "changed_by", "note")))
            )
        ).alias("won")
    )
    return winners.select(F.inline("won"))


def _newest(changes: DataFrame) -> DataFrame:
    """One row per id: the newest given value of each column, in a struct that is null if none was given.

    Changes of one moment come in the order of their values, so that all columns take the
    same one of them, however the log is partitioned.
    """

    def newest(column: str) -> Column:
        return F.max_by(F.struct(F.col(column).alias("value")), _when_given(changes, column)).alias(column)

    return changes.groupBy("id").agg(
        newest("status"),
        F.max(F.when(F.col("status").isNotNull(), F.col("changed_at"))).alias("changed_at"),
        newest("changed_by"),
        newest("note"),
    )


def latest_status(changes: DataFrame) -> DataFrame:
    """One row per id: the newest change, and the newest changer and note given.

    ``max_by`` combines before the shuffle, so an id changed very often costs
    no more than any other.
    """
    return _newest(changes).select(
        "id",
        F.col("status.value").alias("status"),
        "changed_at",
        F.col("changed_by.value").alias("changed_by"),
        F.col("note.value").alias("note"),
    )


def apply_changes(df: DataFrame, changes: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Folds a change log into the entries; a change that :func:`refusal` names is left out."""
    df = with_triage_columns(df)
    new = _newest(changes.where(refusal(changes, overrides).isNull())).select(
        "id",
        F.col("status").alias("_status"),
        F.when(F.col("changed_at").isNotNull(), F.struct(F.col("changed_at").alias("value"))).alias("_at"),
        F.col("changed_by").alias("_by"),
        F.col("note").alias("_note"),
    )
    pairs = {
        "status": "_status",
        "status_changed_at": "_at",
        "status_changed_by": "_by",
        "note": "_note",
    }
    return df.join(new, "id", "left").select(
        *[
            F.when(F.col(pairs[c]).isNotNull(), F.col(f"{pairs[c]}.value")).otherwise(F.col(c)).alias(c)
            if c in pairs
            else F.col(c)
            for c in df.columns
        ]
    )


def set_status_many(
    df: DataFrame,
    ids: Ids,
    status: str,
    now: datetime,
    by: str | None = None,
    overrides: dict | None = None,
) -> DataFrame:
    """Many entries at once; who is overwritten even by null, notes stay."""
    check_status(status, overrides)
    df = with_triage_columns(df)
    flagged = _flag_ids(df, ids, "_hit")
    new = {
        "status": F.lit(status),
        "status_changed_at": instant(now, df.schema["status_changed_at"].dataType),
        "status_changed_by": F.lit(by).cast("string"),
    }
    return flagged.select(
        *[
            F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in df.columns
        ]
    )


def set_note(df: DataFrame, entry_id: str, note: str | None) -> DataFrame:
    """Overwrites the note; null clears it."""
    check_note(note)
    df = with_triage_columns(df)
    return df.withColumn(
        "note",
        F.when(F.col("id") == entry_id, F.lit(note).cast("string")).otherwise(F.col("note")),
    )


def delete(df: DataFrame, entry_id: str) -> DataFrame:
    return df.where(F.col("id") != entry_id)


def listed_rows(df: DataFrame, ids: Ids) -> DataFrame:
    """The entries that are listed."""
    return df.join(_ids_frame(df, ids), "id", "left_semi")


def delete_many(df: DataFrame, ids: Ids) -> DataFrame:
    """The entries without those listed."""
    return df.join(_ids_frame(df, ids), "id", "left_anti")


def count_listed(df: DataFrame, ids: Ids) -> DataFrame:
    """How many entries :func:`delete_many` would take away."""
    return _flag_ids(df.select("id"), ids, "_hit").agg(
        F.count_if(F.col("_hit")).alias("deleted")
    )


def clear_condition(
    levels: filters.Values = None,
    channels: filters.Values = None,
    statuses: filters.Values = None,
) -> Column:
    """What a clear deletes: unlike a listing it has no default status."""
    parts = [filters.level(levels), filters.channel(channels), filters.status(statuses)]
    return F.coalesce(reduce(and_, parts), F.lit(False))


def clear(
    df: DataFrame,
    levels: filters.Values = None,
    channels: filters.Values = None,
    statuses: filters.Values = None,
) -> DataFrame:
    """What is left after deleting the matching rows; no argument deletes all."""
    return df.where(~clear_condition(levels, channels, statuses))
