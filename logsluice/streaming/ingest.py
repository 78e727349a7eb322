"""Ingest as a stream: capture, split off what cannot be stored, append."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsluice.operators.filters import drop_internal
from logsluice.plans.capture import CaptureRules, build, dedupe_capture, ignore, unseen
from logsluice.schema import as_utc
from logsluice.session import path_exists
from logsluice.sources.commits import live_rows
from logsluice.sources.entries import DAY, append_entries, rejects_path, utc_day
from logsluice.streaming.identity import batch_moment, stream_id, with_batch_ids

# How soon rows are written: at once, gathered for a while, or by a worker that
# takes what is there and ends.
MODES = {
    "sync": {"processingTime": "0 seconds"},
    "batch": {"processingTime": "10 seconds"},
    "queue": {"availableNow": True},
}


def capture_batch(
    rows: DataFrame,
    table: str,
    tag: str,
    moment: datetime,
    rules: CaptureRules = CaptureRules(),
    dedupe_key: str | None = "id",
) -> DataFrame:
    """What the capture plan keeps of a micro-batch that is to be stored in ``table``.

    The table itself is the memory for copies: a record is left out if its key is stored
    on one of the days the batch has times of, whatever its age. Rows without a time
    are looked for on the day of ``moment`` and the one before. Rows that the same
    micro-batch stored before, when it is replayed, do not count.
    """
    rows = with_batch_ids(ignore(drop_internal(rows), rules), tag)
    if dedupe_key and dedupe_key in rows.columns:
        rows = dedupe_capture(rows, dedupe_key)
        if path_exists(rows.sparkSession, table):
            rows = unseen(rows, _stored_keys(rows, table, tag, moment, dedupe_key), dedupe_key)
    return build(rows, rules)


def _stored_keys(rows: DataFrame, table: str, tag: str, moment: datetime, key: str) -> DataFrame:
    days = {moment.date(), moment.date() - timedelta(days=1)}
    if "occurred_at" in rows.columns:
        # No more than the days of the batch.
        found = rows.where("occurred_at IS NOT NULL").select(utc_day(rows).alias("day")).distinct()
        days |= {r["day"] for r in found.collect()}
    stored = live_rows(rows.sparkSession, table).where(F.col(DAY).isin(sorted(days)))
    if "batch" in stored.columns:
        stored = stored.where(~F.col("batch").cast("string").eqNullSafe(tag))
    refused = rejects_path(table)
    if not path_exists(rows.sparkSession, refused):
        return stored.select(key)
    # A record that could not be stored is told once, too.
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, batch string"
    held = rows.sparkSession.read.schema(kinds).parquet(refused).where(~F.col("batch").eqNullSafe(tag))
    return stored.select(key).unionByName(held.select(key))


def ingest_stream(
    records: DataFrame,
    table: str,
    checkpoint: str,
    now: datetime | None = None,
    mode: str = "sync",
    rules: CaptureRules = CaptureRules(),
    dedupe_key: str | None = "id",
) -> StreamingQuery:
    """Starts the stream. A replayed micro-batch overwrites what it wrote before.

    Every record is stored once, in whatever order and however late its copies come; the
    stream keeps no state. ``now`` fixes the time given to rows without one; by default it
    is the time the micro-batch is first stored, which a replay finds beside the
    checkpoint. Rows without an id get one from the batch, their place in it and their
    content, so a replay gives them the same one.
    """
    if mode not in MODES:
        raise ValueError(f"unknown write mode: {mode!r}")

    def store(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        tag = f"{stream_id(spark, checkpoint)}-{batch}"
        moment = now or batch_moment(spark, checkpoint, batch)
        # The days, the keys and the rows are asked of the micro-batch; without this it
        # would be read from the source for each.
        rows.persist()
        try:
            kept = capture_batch(rows, table, tag, as_utc(moment), rules, dedupe_key).persist()
            append_entries(kept, table, moment, where="stream", batch=tag)
            kept.unpersist()
        finally:
            rows.unpersist()

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**MODES[mode])
        .start()
    )
