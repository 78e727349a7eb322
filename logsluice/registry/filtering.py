"""Filters over the entries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.operators import filters as f
from logsluice.operators.status import status_dimension
from logsluice.registry.base import LATE, MIDDLE, NOW, entries, entries_query, query

_CUSTOM = {"triaged": {"closed": True}, "resolved": {"closed": False}}


def _filter(name: str, condition, where: str) -> None:
    """A filter given as a Column, next to its WHERE text."""
    entries_query(name, f"SELECT id, level, channel, status, occurred_at FROM le WHERE {where}")(
        lambda le: le.where(condition()).select("id", "level", "channel", "status", "occurred_at")
    )


def register() -> None:
    ntz = T.TimestampNTZType()
    _filter("filter_level", lambda: f.level(["error", "warning"]), "level IN ('error','warning')")
    _filter("filter_exclude_level", lambda: f.exclude_level("debug"), "level NOT IN ('debug')")
    _filter("filter_channel", lambda: f.channel(["stack", "slack"]), "channel IN ('stack','slack')")
    _filter(
        "filter_exclude_channel",
        lambda: f.exclude_channel(["stack", "slack"]),
        "channel IS NULL OR channel NOT IN ('stack','slack')",
    )
    _filter("filter_http_method", lambda: f.http_method("POST"), "http_method = 'POST'")
    _filter(
        "filter_exclude_http_method",
        lambda: f.exclude_http_method(["POST", "PUT"]),
        "http_method IS NULL OR http_method NOT IN ('POST','PUT')",
    )
    _filter("filter_status", lambda: f.status(["resolved", "open"]), "status IN ('resolved','open')")
    _filter("filter_open", lambda: f.is_open(), "status = 'open'")
    _filter("filter_needs_attention", lambda: f.needs_attention(), "status IN ('open','investigating')")
    _filter("filter_closed", lambda: f.closed(), "status IN ('resolved','ignored')")
    _filter(
        "filter_needs_attention_custom",
        lambda: f.needs_attention(_CUSTOM),
        "status IN ('open','investigating','resolved')",
    )
    _filter(
        "filter_date_range",
        lambda: f.date_range("2024-01-10", "2024-01-20T12:00:00+02:00", "Europe/Berlin", dtype=ntz),
        "occurred_at >= TIMESTAMP '2024-01-09 23:00:00' AND occurred_at <= TIMESTAMP '2024-01-20 10:00:00'",
    )
    _filter(
        "filter_date_range_today",
        lambda: f.date_range("today", tz="America/New_York", now=MIDDLE, dtype=ntz),
        "occurred_at >= TIMESTAMP '2024-01-15 05:00:00' AND occurred_at <= TIMESTAMP '2024-01-16 04:59:00'",
    )
    _filter(
        "filter_date_range_relative",
        lambda: f.date_range("-2 weeks", now=LATE, dtype=ntz),
        "occurred_at >= TIMESTAMP '2024-01-16 23:59:00'",
    )
    trace = "c9f0f895-fb98-ab91-59f5-1fd0297e236d"  # md5 of '8'
    _filter("filter_trace_id", lambda: f.trace_id(f" {trace} "), f"trace_id = '{trace}'")
    _filter("filter_trace_id_prefix", lambda: f.trace_id("c9"), "starts_with(trace_id, 'c9')")
    _filter("filter_trace_id_blank", lambda: f.trace_id("   "), "true")
    _filter("filter_user_id", lambda: f.user_id("17"), "user_id = 17")
    _filter(
        "filter_user_id_prefix", lambda: f.user_id("1x"), "starts_with(CAST(user_id AS VARCHAR), '1x')"
    )
    _filter("filter_ip_address", lambda: f.ip_address("10.1.17.1"), "ip_address = '10.1.17.1'")
    _filter("filter_ip_prefix", lambda: f.ip_address("10.1."), "starts_with(ip_address, '10.1.')")
    _filter("filter_url", lambda: f.url("page=7"), "url ILIKE '%page=7%'")
    _filter(
        "filter_min_level",
        lambda: f.min_level("warning"),
        "level IN ('warning','error','critical','alert','emergency')",
    )


register()


@query(
    "filter_truncated",
    "SELECT id FROM le WHERE strlen(message) > 32",
)
def _truncated(spark, sf_dir):
    from logsluice.operators.prepare import truncate_message
    from logsluice.schema import Limits

    flagged = truncate_message(entries(spark, sf_dir), Limits(message_inline=32))
    return flagged.where(f.truncated()).select("id")


@query(
    "status_class_join",
    "SELECT id, status FROM le WHERE status IN ('resolved','ignored')",
)
def _status_class(spark, sf_dir):
    dimension = status_dimension(spark)
    return f.by_status_class(entries(spark, sf_dir), dimension, True).select("id", "status")


_COLUMNS = "id, level, status, occurred_at"
_SELECT = ("id", "level", "status", "occurred_at")


@entries_query(
    "quick_filter_today",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND occurred_at >= TIMESTAMP '2024-01-15 00:00:00' "
    "AND occurred_at <= TIMESTAMP '2024-01-15 23:59:00'",
)
def _today(le):
    return f.quick_filter(le, "Today", MIDDLE).select(*_SELECT)


@entries_query(
    "quick_filter_this_hour",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND occurred_at >= TIMESTAMP '2024-01-15 11:30:00'",
)
def _this_hour(le):
    return f.quick_filter(le, "This Hour", MIDDLE).select(*_SELECT)


@entries_query(
    "quick_filter_last_24_hours",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND occurred_at >= TIMESTAMP '2024-01-30 00:00:00'",
)
def _last_day(le):
    return f.quick_filter(le, "Last 24 Hours", NOW).select(*_SELECT)


@entries_query(
    "quick_filter_recent_errors",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND level IN ('error','critical','alert','emergency') "
    "AND occurred_at >= TIMESTAMP '2024-01-30 00:00:00'",
)
def _recent_errors(le):
    return f.quick_filter(le, "Recent Errors", NOW).select(*_SELECT)


@entries_query(
    "quick_filter_custom",
    f"SELECT {_COLUMNS} FROM le WHERE status IN ('open','investigating') "
    "AND occurred_at >= TIMESTAMP '2024-01-24 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-29 00:00:00'",
)
def _custom_quick(le):
    preset = {"statuses": ["open", "investigating"], "from_": "-7 days", "to": "-2 days"}
    return f.quick_filter(le, "Attention", NOW, presets={"Attention": preset}).select(*_SELECT)


@entries_query(
    "pivot_ip",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND starts_with(ip_address, '10.2.') "
    "AND occurred_at >= TIMESTAMP '2024-01-10 00:00:00'",
)
def _pivot_ip(le):
    return f.pivot(le, "ip_address", "10.2.", ("2024-01-10", None)).select(*_SELECT)


@entries_query(
    "pivot_trace",
    f"SELECT {_COLUMNS} FROM le WHERE status='open' AND starts_with(trace_id, 'c') "
    "AND occurred_at >= TIMESTAMP '2024-01-10 00:00:00'",
)
def _pivot_trace(le):
    return f.pivot(le, "trace_id", "c", ("2024-01-10", None)).select(*_SELECT)


@entries_query("pivot_user_all_statuses", f"SELECT {_COLUMNS} FROM le WHERE user_id = 23")
def _pivot_user(le):
    return f.pivot(le, "user_id", 23, all_statuses=True).select(*_SELECT)


@entries_query(
    "drop_internal",
    "SELECT id, context FROM le WHERE context IS NULL OR json_extract(context, '$.k')::INT >= 50",
)
def _drop_internal(le):
    mark = "_internal"
    marked = F.when(
        F.get_json_object("context", "$.k").cast("int") < 50,
        F.replace("context", F.lit("}"), F.lit(f', "{mark}": true}}')),
    ).otherwise(F.col("context"))
    return f.drop_internal(le.withColumn("context", marked), mark).select("id", "context")


@entries_query(
    "drop_deprecations",
    """, d AS (SELECT id, channel, CASE WHEN source_line % 3 = 0 THEN concat(message, ' is deprecated in x.php on line ', CAST(source_line AS VARCHAR))
         WHEN source_line % 3 = 1 THEN concat(message, ' is deprecated for billing') ELSE message END AS message FROM le)
    SELECT id, channel, message FROM d WHERE (channel IS NULL OR channel <> 'deprecations')
      AND NOT (contains(message, 'is deprecated') AND regexp_matches(message, ' on line \\d+$'))""",
)
def _drop_deprecations(le):
    third = F.col("source_line") % 3
    worded = (
        F.when(third == 0, F.concat("message", F.lit(" is deprecated in x.php on line "), F.col("source_line").cast("string")))
        .when(third == 1, F.concat("message", F.lit(" is deprecated for billing")))
        .otherwise(F.col("message"))
    )
    return f.drop_deprecations(le.withColumn("message", worded)).select("id", "channel", "message")


@entries_query("drop_null_channel", "SELECT id, channel FROM le WHERE channel IS NOT NULL")
def _drop_null_channel(le):
    return f.drop_null_channel(le, enabled=True).select("id", "channel")


@entries_query(
    "apply_filters",
    "SELECT id, message, occurred_at FROM le WHERE status IN ('open','investigating') AND level IN ('error','warning','info') "
    "AND level NOT IN ('info') AND (channel IS NULL OR channel NOT IN ('deprecations')) "
    "AND message ILIKE '%user 1%' AND occurred_at >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND starts_with(ip_address, '10.') AND http_method IN ('POST','PUT','PATCH') "
    "AND (http_method IS NULL OR http_method NOT IN ('PATCH')) AND url ILIKE '%page=%'",
)
def _apply(le):
    return f.apply_filters(
        le,
        statuses=["open", "investigating"],
        levels=["error", "warning", "info"],
        exclude_levels="info",
        exclude_channels="deprecations",
        searches=[{"field": "message", "value": "user 1"}],
        from_="2024-01-05",
        trace=" ",
        ip="10.",
        methods=["POST", "PUT", "PATCH"],
        exclude_methods=["PATCH"],
        url_part="page=",
    ).select("id", "message", "occurred_at")
