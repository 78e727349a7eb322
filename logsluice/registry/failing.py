"""Failed writes: heartbeat, fallback rows, summaries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from logsluice.operators import failures as fl
from logsluice.registry.base import LATE, NOW, entries, entries_query, query
from logsluice.session import scratch_path
from logsluice.sources.entries import append_entries, read_entries, rejects_path

# Error entries seen as failed writes at seven throw sites.
_FAILURES = """, fa AS (SELECT id, occurred_at AS "at", concat('E', right(source, 5)) AS class, source AS file, 1 AS line,
  concat(message, repeat('x', 600)) AS error, 'listener' AS "where",
  CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN '08006' WHEN 1 THEN '40001' ELSE '42000' END AS code,
  level, message, channel, trace_id, occurred_at FROM le WHERE level = 'error')
"""


def failures_of(le):
    return le.where("level = 'error'").select(
        "id",
        F.col("occurred_at").alias("at"),
        F.concat(F.lit("E"), F.substring("source", -5, 5)).alias("class"),
        F.col("source").alias("file"),
        F.lit(1).alias("line"),
        F.concat("message", F.repeat(F.lit("x"), 600)).alias("error"),
        F.lit("listener").alias("where"),
        F.expr("CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN '08006' WHEN 1 THEN '40001' ELSE '42000' END").alias("code"),
        "level",
        "message",
        "channel",
        "trace_id",
        "occurred_at",
    )


@entries_query(
    "heartbeat_one_instant",
    _FAILURES
    + """SELECT id, line, occurrence FROM (SELECT id, line, row_number() OVER (PARTITION BY line ORDER BY id) AS occurrence FROM fa)
    WHERE occurrence = 1 OR occurrence % 10 = 0""",
)
def _one_instant(le):
    """All failures at one instant and under one key: a single slice, split by the order of their ids."""
    failed = failures_of(le).withColumn("at", F.lit(NOW))
    beats = fl.heartbeat(failed, key=["line"], order=["at", "id"], every=10, hot_rows=500)
    return beats.select("id", "line", "occurrence")


_NUMBERED = _FAILURES + """, n AS (SELECT *, row_number() OVER (PARTITION BY class, file, line ORDER BY "at", id) AS occurrence FROM fa)
"""


@entries_query(
    "heartbeat",
    _NUMBERED + "SELECT id, class, occurrence FROM n WHERE occurrence = 1 OR occurrence % 10 = 0",
)
def _heartbeat(le):
    beats = fl.heartbeat(failures_of(le), order=["at", "id"], every=10)
    return beats.select("id", "class", "occurrence")


@entries_query(
    "heartbeat_scoped",
    _FAILURES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY channel, class, file, line ORDER BY "at", id) AS occurrence FROM fa)
    SELECT id, channel, occurrence FROM n WHERE occurrence = 1 OR occurrence % 5 = 0""",
)
def _scoped(le):
    beats = fl.heartbeat(failures_of(le), order=["at", "id"], every=5, scope=["channel"])
    return beats.select("id", "channel", "occurrence")


@entries_query(
    "heartbeat_one_key",
    """, n AS (SELECT id, row_number() OVER (ORDER BY occurred_at, id) AS occurrence FROM le)
    SELECT id, occurrence FROM n WHERE occurrence = 1 OR occurrence % 100 = 0""",
)
def _one_key(le):
    same = le.select("id", "occurred_at", F.lit("E").alias("class"))
    beats = fl.heartbeat(same, ["class"], ["occurred_at", "id"], slice_seconds=3600)
    return beats.select("id", "occurrence")


@entries_query(
    "fallback_rows",
    _NUMBERED
    + """SELECT level, message, channel, trace_id, occurred_at,
      '{"_write_failure":{"exception_class":"' || class || '","exception_message":"' || error || '","where":"listener","occurrence":' || CAST(occurrence AS VARCHAR) || '}}' AS context
    FROM n WHERE occurrence = 1 OR occurrence % 20 = 0""",
)
def _fallback(le):
    rows = fl.fallback_rows(failures_of(le), "listener", NOW, ["at", "id"], every=20)
    return rows.select("level", "message", "channel", "trace_id", "occurred_at", "context")


@entries_query(
    "split_valid",
    """SELECT id, CASE WHEN level = 'info' THEN 'message is missing' WHEN level = 'error' AND channel IS NOT NULL THEN 'channel is longer than 100 characters' ELSE 'stored' END AS verdict FROM le""",
)
def _split(le):
    broken = le.withColumns(
        {
            "message": F.when(F.col("level") != "info", F.col("message")),
            "channel": F.when(F.col("level") == "error", F.repeat("channel", 40)).otherwise(F.col("channel")),
        }
    )
    good, bad = fl.split_valid(broken)
    return good.select("id", F.lit("stored").alias("verdict")).unionByName(
        bad.select("id", F.col("reason").alias("verdict"))
    )


@entries_query(
    "split_retryable",
    _FAILURES + "SELECT id, code, code IN ('08006','40001') AS again FROM fa",
)
def _retryable(le):
    again, rest = fl.split_retryable(failures_of(le))
    return again.select("id", "code", F.lit(True).alias("again")).unionByName(
        rest.select("id", "code", F.lit(False).alias("again"))
    )


@entries_query(
    "failure_counts", _FAILURES + "SELECT class, file, line, count(*) AS count FROM fa GROUP BY ALL"
)
def _counts(le):
    return fl.failure_counts(failures_of(le))


_SUMMARY = """SELECT count(*) AS count, min("at") AS first_at, arg_max(class, "at") AS last_class,
  arg_max(left(error, 500) || '… [truncated]', "at") AS last_message, arg_max("where", "at") AS last_where, max("at") AS last_at FROM """


@entries_query("failure_summary", _FAILURES + _SUMMARY + "fa")
def _summary(le):
    return fl.failure_summary(failures_of(le))


@entries_query("failure_summary_none", _FAILURES + "SELECT count(*) AS n FROM fa WHERE false")
def _no_summary(le):
    none = fl.failure_summary(failures_of(le).where("code = 'none'"))
    return none.agg(F.count(F.lit(1)).alias("n"))


@entries_query(
    "failures_since_dismiss", _FAILURES + _SUMMARY + "fa WHERE \"at\" > TIMESTAMP '2024-01-20 00:00:00'"
)
def _dismissed(le):
    since = datetime(2024, 1, 20, tzinfo=timezone.utc)
    return fl.failure_summary(fl.failures_since_dismiss(failures_of(le), since))


@entries_query(
    "failures_since_pause",
    _FAILURES
    + """, q AS (SELECT *, "at" - lag("at") OVER (ORDER BY "at", id) AS pause FROM fa),
    s AS (SELECT max("at") FILTER (WHERE pause IS NULL OR pause > INTERVAL 2 HOUR) AS start, max("at") AS last FROM q)
    SELECT id, "at" FROM q, s WHERE q."at" >= s.start AND s.last > TIMESTAMP '2024-01-30 21:59:59'""",
)
def _paused(le):
    return fl.failures_since_dismiss(failures_of(le), None, 2 * 3600, LATE).select("id", "at")


@query(
    "append_entries",
    """, b AS (SELECT *, CASE WHEN level = 'info' THEN NULL ELSE message END AS said FROM le),
    n AS (SELECT *, row_number() OVER (ORDER BY occurred_at, level, said, id) AS occurrence FROM b WHERE said IS NULL)
    SELECT id, level, said AS message, channel, context, date_trunc('second', occurred_at) AS occurred_at FROM b WHERE said IS NOT NULL
    UNION ALL SELECT NULL, level, '(unknown message)', channel,
      '{"_write_failure":{"exception_class":"InvalidEntry","exception_message":"message is missing","where":"append","occurrence":' || CAST(occurrence AS VARCHAR) || '}}',
      date_trunc('second', occurred_at) FROM n WHERE occurrence = 1 OR occurrence % 100 = 0""",
)
def _append(spark, sf_dir):
    le = entries(spark, sf_dir)
    broken = le.withColumn("message", F.when(F.col("level") != "info", F.col("message")))
    path = scratch_path(spark, "appended")
    append_entries(broken, path, NOW)
    fallback = F.coalesce(F.contains("context", F.lit("_write_failure")), F.lit(False))
    return read_entries(spark, path).select(
        F.when(~fallback, F.col("id")).alias("id"), "level", "message", "channel", "context",
        "occurred_at",
    )


@query(
    "append_keeps_rejects",
    """SELECT level, count(*) FILTER (WHERE level <> 'info') AS stored, count(*) FILTER (WHERE level = 'info') AS rejected
    FROM le GROUP BY level""",
)
def _rejects(spark, sf_dir):
    le = entries(spark, sf_dir)
    broken = le.withColumn("message", F.when(F.col("level") != "info", F.col("message")))
    path = scratch_path(spark, "appended")
    append_entries(broken, path, NOW)
    fallback = F.coalesce(F.contains("context", F.lit("_write_failure")), F.lit(False))
    good = read_entries(spark, path).where(~fallback).select("level", F.lit(1).alias("s"), F.lit(0).alias("r"))
    bad = spark.read.parquet(rejects_path(path)).select("level", F.lit(0).alias("s"), F.lit(1).alias("r"))
    both = good.unionByName(bad).groupBy("level")
    return both.agg(F.sum("s").alias("stored"), F.sum("r").alias("rejected"))
