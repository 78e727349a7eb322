"""Streaming forms, run over what is there and read back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from logsluice.operators.stats import stats_of_quarters
from logsluice.schema import to_instant, to_wall
from logsluice.plans.capture import dedupe_capture
from logsluice.registry.base import ENTRIES_SQL, LATE, NOW, query
from logsluice.registry.failing import _FAILURES, failures_of
from logsluice.session import scratch_path
from logsluice.sources.entries import read_entries
from logsluice.streaming.heartbeat import heartbeat_stream
from logsluice.streaming.ingest import ingest_stream
from logsluice.streaming.stats import stats_quarters_stream, stats_stream


def entries_stream(spark, sf_dir):
    """The entries as a stream of the events file; times as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file stream watches a folder.
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events = files.parquet(sf_dir)
    le = spark.sql(ENTRIES_SQL, events=events)
    return le.withColumn("occurred_at", to_instant(F.col("occurred_at")))


def _finish(writer, checkpoint: str) -> None:
    stream = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


@query(
    "ingest_stream",
    r"""SELECT id, level, message, context, regexp_replace(url, 'api_token=[^&#]*', 'api_token=%5BREDACTED%5D') AS url,
    date_trunc('second', occurred_at) AS occurred_at, status, is_truncated FROM (SELECT *, false AS is_truncated FROM le)
    WHERE channel IS NULL OR channel <> 'deprecations'""",
)
def _ingest(spark, sf_dir):
    path = scratch_path(spark, "ingested")
    stream = ingest_stream(
        entries_stream(spark, sf_dir), path, scratch_path(spark, "checkpoint"), NOW, mode="queue"
    )
    stream.awaitTermination()
    return read_entries(spark, path).select(
        "id", "level", "message", "context", "url",
        to_wall(F.col("occurred_at")).alias("occurred_at"), "status", "is_truncated",
    )


@query(
    "ingest_out_of_order",
    """SELECT id, level, date_trunc('second', occurred_at) AS occurred_at FROM le
    WHERE channel IS NULL OR channel <> 'deprecations'""",
)
def _ingest_out_of_order(spark, sf_dir):
    """Newest records first, then older ones, then all of them a second time, a micro-batch each."""
    path, source = scratch_path(spark, "ingested"), scratch_path(spark, "arrivals")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(ENTRIES_SQL, events=events).withColumn("occurred_at", to_instant(F.col("occurred_at")))
    half = F.lit("2024-01-16 00:00:00 UTC").cast("timestamp")
    for part in (rows.where(F.col("occurred_at") >= half), rows.where(F.col("occurred_at") < half), rows):
        part.write.mode("append").parquet(source)
    records = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(source)
    ingest_stream(records, path, scratch_path(spark, "checkpoint"), NOW, mode="queue").awaitTermination()
    return read_entries(spark, path).select("id", "level", to_wall(F.col("occurred_at")).alias("occurred_at"))


@query("dedupe_stream", "SELECT id, level FROM le")
def _dedupe(spark, sf_dir):
    out = scratch_path(spark, "deduped")
    rows = entries_stream(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = dedupe_capture(twice, "id")
    _finish(
        once.select("id", "level").writeStream.format("parquet").option("path", out),
        scratch_path(spark, "checkpoint"),
    )
    return spark.read.parquet(out)


@query(
    "stats_stream",
    """SELECT level, count(*) AS total,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 00:00:00') AS today,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 23:00:00') AS this_hour
    FROM le GROUP BY level""",
)
def _stats(spark, sf_dir):
    out = scratch_path(spark, "stats")
    kept = stats_stream(entries_stream(spark, sf_dir), LATE)
    _finish(
        kept.writeStream.outputMode("complete").foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(out)
        ),
        scratch_path(spark, "checkpoint"),
    )
    return spark.read.parquet(out)


@query(
    "stats_stream_later",
    """SELECT level, count(*) AS total,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-29 00:00:00') AS today,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-29 13:00:00') AS this_hour
    FROM le GROUP BY level""",
)
def _stats_later(spark, sf_dir):
    out = scratch_path(spark, "quarters")
    _finish(
        stats_quarters_stream(entries_stream(spark, sf_dir))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(out)),
        scratch_path(spark, "checkpoint"),
    )
    return stats_of_quarters(spark.read.parquet(out), datetime(2024, 1, 29, 13, 20, tzinfo=timezone.utc))


@query(
    "ingest_without_ids",
    """SELECT level, count(*) AS rows FROM le WHERE channel IS NULL OR channel <> 'deprecations' GROUP BY level""",
)
def _ingest_without_ids(spark, sf_dir):
    path = scratch_path(spark, "ingested")
    own = F.when(F.right("id", F.lit(1)) == "7", F.col("id"))
    rows = entries_stream(spark, sf_dir).withColumn("id", own)
    ingest_stream(rows, path, scratch_path(spark, "checkpoint"), NOW, mode="queue").awaitTermination()
    return read_entries(spark, path).groupBy("level").agg(F.count_distinct("id").alias("rows"))


@query(
    "stats_stream_windows",
    """SELECT date_trunc('day', occurred_at) AS window_start, date_trunc('day', occurred_at) + INTERVAL 1 DAY AS window_end,
    level, count(*) AS total FROM le GROUP BY ALL""",
)
def _windows(spark, sf_dir):
    out = scratch_path(spark, "windows")
    kept = stats_stream(entries_stream(spark, sf_dir), window="1 day", delay="40 days")
    _finish(
        kept.writeStream.outputMode("complete").foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(out)
        ),
        scratch_path(spark, "checkpoint"),
    )
    return spark.read.parquet(out).withColumns(
        {c: to_wall(F.col(c)) for c in ("window_start", "window_end")}
    )


@query(
    "heartbeat_stream",
    _FAILURES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY class, file, line ORDER BY "at", id) AS occurrence FROM fa)
    SELECT id, class, occurrence FROM n WHERE occurrence = 1 OR occurrence % 10 = 0""",
)
def _heartbeat(spark, sf_dir):
    out = scratch_path(spark, "beats")
    stream = heartbeat_stream(
        failures_of(entries_stream(spark, sf_dir)),
        out,
        scratch_path(spark, "counters"),
        scratch_path(spark, "checkpoint"),
        order=["at", "id"],
        every=10,
    )
    stream.awaitTermination()
    return spark.read.parquet(out).select("id", "class", "occurrence")


@query(
    "heartbeat_stream_batches",
    _FAILURES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY class, file, line ORDER BY "at", id) AS occurrence FROM fa)
    SELECT id, class, occurrence FROM n WHERE occurrence = 1 OR occurrence % 10 = 0""",
)
def _heartbeat_batches(spark, sf_dir):
    """The failures of three days to a micro-batch, so that counters are merged on the way."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "beats")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = failures_of(spark.sql(ENTRIES_SQL, events=events)).drop("error", "message")
    for day in range(1, 31, 3):
        three = F.floor((F.day("at") - 1) / 3) == (day - 1) // 3 if day < 28 else F.day("at") >= day
        failed.where(three).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(failed.schema).option("maxFilesPerTrigger", "1").parquet(source)
    heartbeat_stream(
        arriving, out, scratch_path(spark, "counters"), scratch_path(spark, "checkpoint"), order=["at", "id"], every=10
    ).awaitTermination()
    return spark.read.parquet(out).select("id", "class", "occurrence")
