"""Text logs: the entries written as multi-line records and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.schema import to_wall
from logsluice.functions.records import (
    channel_from_path,
    source_from_text,
    split_header,
    split_json_tail,
    with_json_tail,
    with_source,
)
from logsluice.registry.base import NOW, entries, query
from logsluice.session import scratch_path
from logsluice.sources import textlogs
from logsluice.sources.entries import read_entries
from logsluice.streaming.follow import follow_files

# The same text for both engines: what a record's message says after the header.
_TEXT = """CASE WHEN level = 'error' THEN concat(message, ' in ', source, ':', CAST(source_line AS VARCHAR(9))) ELSE message END"""
_LINES = """CASE right(id, 1) WHEN '1' THEN chr(10) || '[stacktrace]' || chr(10) || '#0 frame' WHEN '2' THEN chr(10) || '#0 {main}' ELSE '' END"""

# What the parser should make of each entry. A context ends up inside the
# message when further lines follow it.
_PARSED = f""", p AS (SELECT *, {_TEXT} AS said, {_LINES} AS more FROM le),
parsed AS (SELECT level,
  CASE WHEN more = '' THEN said ELSE said || coalesce(' ' || context, '') || more END AS message,
  CASE WHEN more = '' AND context IS NOT NULL THEN context ELSE '[]' END AS context,
  source, source_line, occurred_at, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day FROM p)
"""


def write_text(spark, sf_dir: str, purpose: str) -> str:
    """The entries as text logs in one folder per day, each with one more file
    that holds no record at all. Returns the folder."""
    folder = scratch_path(spark, purpose)
    le = entries(spark, sf_dir)
    record = F.concat(
        F.lit("["),
        F.col("occurred_at").cast("string"),
        F.lit("] local."),
        F.upper("level"),
        F.lit(": "),
        F.expr(_TEXT),
        F.coalesce(F.concat(F.lit(" "), "context"), F.lit("")),
        F.expr(_LINES),
    )
    lines = le.select(record.alias("value"), F.to_date("occurred_at").alias("day"))
    junk = lines.select(F.lit("rotated\n#0 left over").alias("value"), "day").distinct()
    # Files of their own: nothing in them belongs to a record.
    lines.repartition(8, "day").write.partitionBy("day").text(folder)
    junk.repartition(1).write.mode("append").partitionBy("day").text(folder)
    return folder


def _day(path):
    return F.regexp_extract(path, "day=([0-9-]+)", 1)


@query("parse_log_text", _PARSED + "SELECT level, message, context, source, source_line, occurred_at FROM parsed")
def _parse(spark, sf_dir):
    folder = write_text(spark, sf_dir, "parse")
    parsed = textlogs.parse_log_text(spark, f"{folder}/*/*")
    return parsed.select(
        "level", "message", "context", "source", "source_line",
        to_wall(F.col("occurred_at")).alias("occurred_at"),
    )


@query(
    "count_entries",
    _PARSED + "SELECT day, count(*) AS count FROM parsed GROUP BY day",
)
def _count(spark, sf_dir):
    folder = write_text(spark, sf_dir, "count")
    per_file = textlogs.count_entries(textlogs.parse_log_text(spark, f"{folder}/*/*", NOW, 7))
    return per_file.groupBy(_day("file").alias("day")).agg(F.sum("count").alias("count"))


@query(
    "import_summary",
    _PARSED
    + """SELECT coalesce(day, 'total') AS day, CAST(count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-24 00:00:00') AS BIGINT) AS imported,
    CAST(count(*) FILTER (WHERE occurred_at < TIMESTAMP '2024-01-24 00:00:00') AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS unparsed
    FROM parsed GROUP BY ROLLUP (day)""",
)
def _summary(spark, sf_dir):
    folder = write_text(spark, sf_dir, "summary")
    summary = textlogs.import_summary(textlogs.parse_all(spark, f"{folder}/*/*", NOW, 7))
    day = F.coalesce(F.nullif(_day("file"), F.lit("")), F.lit("total"))
    return summary.groupBy(day.alias("day")).agg(
        *[F.sum(c).alias(c) for c in ("imported", "skipped", "unparsed")]
    )


@query(
    "import_logs",
    _PARSED
    + """SELECT level, message, context, source, source_line, date_trunc('second', occurred_at) AS occurred_at, 'open' AS status, false AS is_truncated
    FROM parsed WHERE occurred_at >= TIMESTAMP '2024-01-24 00:00:00'""",
)
def _import(spark, sf_dir):
    folder, table = write_text(spark, sf_dir, "import"), scratch_path(spark, "imported")
    textlogs.import_logs(spark, f"{folder}/*/*", table, NOW, days=7)
    # Again and fresh: the second import replaces the first.
    textlogs.import_logs(spark, f"{folder}/*/*", table, NOW, days=7, fresh=True)
    return read_entries(spark, table).select(
        "level", "message", "context", "source", "source_line",
        to_wall(F.col("occurred_at")).alias("occurred_at"), "status", "is_truncated",
    )


@query("import_ids", "SELECT count(*) AS rows, count(*) AS ids FROM le")
def _import_ids(spark, sf_dir):
    folder, table = write_text(spark, sf_dir, "ids"), scratch_path(spark, "imported")
    textlogs.import_logs(spark, f"{folder}/*/*", table, NOW, days=0)
    return read_entries(spark, table).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids")
    )


@query(
    "list_log_files",
    _PARSED
    + "SELECT day, true AS has_size, true AS has_time FROM parsed GROUP BY day",
)
def _list(spark, sf_dir):
    folder = write_text(spark, sf_dir, "list")
    files = textlogs.list_log_files(spark, f"{folder}/*/*", pattern="*.txt")
    return files.groupBy(_day("path").alias("day")).agg(
        F.bool_and(F.col("size") > 0).alias("has_size"),
        F.bool_and(F.col("modified").isNotNull()).alias("has_time"),
    )


@query(
    "follow_files",
    _PARSED
    + """SELECT level, message, context, source, source_line, date_trunc('second', occurred_at) AS occurred_at FROM parsed""",
)
def _follow(spark, sf_dir):
    folder, table = write_text(spark, sf_dir, "follow"), scratch_path(spark, "followed")
    stream = follow_files(
        spark, f"{folder}/*", table, scratch_path(spark, "checkpoint"), NOW, pattern="*.txt"
    )
    stream.awaitTermination()
    return read_entries(spark, table).select(
        "level", "message", "context", "source", "source_line",
        to_wall(F.col("occurred_at")).alias("occurred_at"),
    )


@query(
    "channel_from_path",
    """SELECT id, CASE WHEN level = 'info' THEN level || '-2024' ELSE level END AS channel FROM le""",
)
def _channel(spark, sf_dir):
    day = F.date_format("occurred_at", "yyyy-MM-dd")
    path = F.concat(
        F.lit("file:///var/log/app-2024-01-01/"), "level",
        F.when(F.col("level") == "debug", F.lit(""))
        .when(F.col("level") == "info", F.lit("-2024"))
        .otherwise(F.concat(F.lit("-"), day)),
        F.lit(".log"),
    )
    return entries(spark, sf_dir).select("id", channel_from_path(path).alias("channel"))


@query(
    "split_header",
    """SELECT id, CASE WHEN level = 'debug' THEN NULL WHEN level = 'info' THEN date_trunc('second', occurred_at) - INTERVAL 2 HOUR
      ELSE date_trunc('second', occurred_at) END AS occurred_at, 'production' AS environment, level, message AS rest FROM le""",
)
def _header(spark, sf_dir):
    moment = (
        F.when(F.col("level") == "debug", F.lit("2024-02-30 25:00:00"))
        .when(
            F.col("level") == "info",
            F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        )
        .otherwise(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))
    )
    line = F.concat(
        F.lit("["), moment, F.lit("] production."), F.upper("level"), F.lit(": "), "message"
    )
    head = entries(spark, sf_dir).select("id", split_header(line).alias("h")).select("id", "h.*")
    return head.withColumn("occurred_at", to_wall(F.col("occurred_at")))


@query(
    "split_json_tail",
    """SELECT id, CASE WHEN level = 'error' THEN message || ' {broken' || coalesce(' ' || context, '') ELSE message END AS message,
    CASE WHEN level = 'error' THEN '[]' ELSE coalesce(context, '[]') END AS context FROM le""",
)
def _tail(spark, sf_dir):
    # An earlier " {" makes the whole rest the candidate, which then is no JSON.
    text = F.concat(
        "message",
        F.when(F.col("level") == "error", F.lit(" {broken")).otherwise(""),
        F.coalesce(F.concat(F.lit(" "), "context"), F.lit("")),
        F.lit("  \n"),
    )
    return with_json_tail(entries(spark, sf_dir).select("id", text.alias("message")))


@query(
    "source_from_text",
    """SELECT id, source, source_line FROM le WHERE level = 'error'
    UNION ALL SELECT id, '/ctx/' || level || '.php', 9 FROM le WHERE level IN ('info','notice')
    UNION ALL SELECT id, NULL, NULL FROM le WHERE level IN ('debug','warning')""",
)
def _source(spark, sf_dir):
    message = F.when(
        F.col("level") == "error",
        F.concat("message", F.lit(" in "), "source", F.lit(":"), F.col("source_line").cast("string")),
    ).otherwise(F.col("message"))
    context = (
        F.when(
            F.col("level").isin("info", "notice", "error"),
            F.concat(F.lit('{"exception":"E: x in /ctx/'), "level", F.lit('.php:9 #0"}')),
        )
        .when(F.col("level") == "debug", F.lit('{"exception":{"at":"in /obj.php:1"}}'))
        .otherwise(F.col("context"))
    )
    rows = entries(spark, sf_dir).select("id", message.alias("message"), context.alias("context"))
    return with_source(rows).select("id", "source", "source_line")


@query(
    "split_record_columns",
    """SELECT id, CASE WHEN context IS NULL THEN message ELSE message || ' in /app/x.php:' || right(id, 1) END AS message,
    coalesce(context, '[]') AS context, CASE WHEN context IS NOT NULL THEN '/app/x.php' END AS source,
    CASE WHEN context IS NOT NULL THEN CAST(right(id, 1) AS INTEGER) END AS source_line FROM le""",
)
def _record_columns(spark, sf_dir):
    # The same two steps as plain columns.
    at = F.concat(F.lit(" in /app/x.php:"), F.substring("id", -1, 1), F.lit(" "), "context")
    text = F.concat("message", F.coalesce(at, F.lit("")))
    tail = entries(spark, sf_dir).select("id", split_json_tail(text).alias("t"))
    found = tail.select("id", "t.*", source_from_text(F.col("t.message"), F.col("t.context")).alias("s"))
    return found.select("id", "message", "context", "s.*")
