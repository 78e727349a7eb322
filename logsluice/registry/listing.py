"""Pages, counts, statistics and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.operators import paging, stats
from logsluice.operators.filters import apply_filters
from logsluice.operators.prepare import add_previews, conform
from logsluice.plans.listing import list_entries, list_table, newest_page
from logsluice.registry.base import LATE, MIDDLE, NOW, entries, entries_query, query
from logsluice.registry.base import table
from logsluice.session import scratch_path
from logsluice.sources.entries import read_entries, write_entries

_ROW = "id, level, message, channel, occurred_at, status"
_ROW_COLUMNS = ("id", "level", "message", "channel", "occurred_at", "status")
# A position in the middle of `events` at every scale.
_CURSOR = paging.make_cursor(MIDDLE, "00000000000000000000000500")
_BEFORE = (
    "(occurred_at < TIMESTAMP '2024-01-15 12:30:00' OR (occurred_at = TIMESTAMP '2024-01-15 12:30:00' "
    "AND id < '00000000000000000000000500'))"
)

OPEN_ERRORS_SQL = (
    f"SELECT {_ROW} FROM le WHERE status='open' AND level='error' AND message ILIKE '%failed%' "
    "AND NOT (coalesce(message,'') ILIKE '%deprecated%' OR coalesce(context,'') ILIKE '%deprecated%' "
    "OR coalesce(source,'') ILIKE '%deprecated%') AND occurred_at >= TIMESTAMP '2024-01-30 00:00:00' "
    "ORDER BY occurred_at DESC, id DESC LIMIT 50"
)


@query("open_errors_page", OPEN_ERRORS_SQL)
def open_errors_page(spark, sf_dir):
    """The flagship: open errors of the last day matching a search, first page."""
    page = list_entries(
        entries(spark, sf_dir),
        levels="error",
        search_for="message:failed -deprecated",
        from_="-24 hours",
        now=NOW,
    )
    return page.rows.select(*_ROW_COLUMNS)


@query(
    "open_errors_meta",
    """, f AS (SELECT occurred_at, id FROM le WHERE status='open' AND level='error' AND occurred_at >= TIMESTAMP '2024-01-10 00:00:00'),
    p AS (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS rn FROM f)
    SELECT (SELECT count(*) FROM f) > 20 AS has_next,
      (SELECT CASE WHEN (SELECT count(*) FROM f) > 20 THEN base64(encode('{"occurred_at":"' || strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') || '","id":"' || id || '"}')) END FROM p WHERE rn = 20) AS next_cursor,
      20 AS per_page, least((SELECT count(*) FROM f), 1000) AS count, (SELECT count(*) FROM f) > 1000 AS has_next_count""",
)
def _meta(spark, sf_dir):
    return list_entries(entries(spark, sf_dir), per_page=20, levels="error", from_="2024-01-10").meta


@entries_query("recent", f"SELECT {_ROW} FROM le ORDER BY occurred_at DESC, id DESC")
def _recent(le):
    return paging.recent(le).select(*_ROW_COLUMNS)


@entries_query("after_cursor", f"SELECT {_ROW} FROM le WHERE {_BEFORE}")
def _after(le):
    return paging.after_cursor(le, _CURSOR).select(*_ROW_COLUMNS)


@entries_query("after_bad_cursor", "SELECT count(*) AS n FROM le")
def _after_bad(le):
    return paging.after_cursor(le, "!!!invalid!!!").agg(F.count(F.lit(1)).alias("n"))


@entries_query(
    "page_after_cursor",
    f"SELECT {_ROW} FROM le WHERE {_BEFORE} AND status='open' ORDER BY occurred_at DESC, id DESC LIMIT 100",
)
def _page(le):
    return paging.page(apply_filters(le), per_page=500, cursor=_CURSOR).select(*_ROW_COLUMNS)


@entries_query(
    "capped_count_under",
    "SELECT least(count(*), 1000000000) AS count, count(*) > 1000000000 AS has_next_count FROM le WHERE level='error'",
)
def _count_all(le):
    return paging.capped_count(apply_filters(le, levels="error", all_statuses=True), 1_000_000_000)


@entries_query(
    "capped_count",
    "SELECT least(count(*), 1000) AS count, count(*) > 1000 AS has_next_count FROM le",
)
def _count(le):
    return paging.capped_count(le)


@entries_query(
    "list_view",
    "SELECT id, level, message, context, CASE WHEN length(message) <= 25 THEN message ELSE left(message, 22) || '...' END AS message_preview, "
    "context AS context_preview, channel, source, source_line, occurred_at, status, trace_id, user_id, ip_address, http_method, url, "
    "false AS is_truncated FROM le",
)
def _list_view(le):
    from logsluice.schema import Limits

    rows = add_previews(le, Limits(message_preview=25), unit="chars")
    return paging.list_view(rows.withColumn("is_truncated", F.lit(False)))


@entries_query("find_entry", "SELECT id, message, status FROM le WHERE id = '00000000000000000000000042'")
def _find(le):
    return paging.find(le, "42".zfill(26)).select("id", "message", "status")


@entries_query("find_absent", "SELECT id, message, status FROM le WHERE id = 'absent'")
def _find_absent(le):
    return paging.find(le, "absent").select("id", "message", "status")


@entries_query(
    "stats_by_level",
    """SELECT level, count(*) AS total,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 00:00:00') AS today,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 23:00:00') AS this_hour
    FROM le GROUP BY level""",
)
def _stats(le):
    return stats.stats_by_level(le, LATE)


@entries_query(
    "stats_by_level_zone",
    """SELECT level, count(*) AS total,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-14 18:30:00') AS today,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-15 12:30:00') AS this_hour
    FROM le GROUP BY level""",
)
def _stats_zone(le):
    return stats.stats_by_level(le, MIDDLE, "Asia/Kolkata")


@entries_query(
    "stats_total",
    """, l AS (SELECT level, count(*) AS total,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 00:00:00') AS today,
      count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-30 23:00:00') AS this_hour FROM le GROUP BY level)
    SELECT CAST(sum(total) AS BIGINT) AS total,
      '{' || string_agg('"' || level || '":' || CAST(total AS VARCHAR), ',' ORDER BY level) || '}' AS by_level,
      CAST(sum(today) AS BIGINT) AS today, CAST(sum(this_hour) AS BIGINT) AS this_hour FROM l""",
)
def _total(le):
    return stats.stats_total(le, LATE)


@entries_query("facet_levels", "SELECT DISTINCT level AS value FROM le ORDER BY 1")
def _levels(le):
    return stats.facet(le, "level")


@entries_query(
    "facet_channels",
    "SELECT DISTINCT channel AS value FROM le WHERE channel IS NOT NULL AND contains(lower(channel), 'a') ORDER BY 1",
)
def _channels(le):
    return stats.facet(le, "channel", " A ")


@entries_query(
    "facet_methods", "SELECT DISTINCT http_method AS value FROM le WHERE http_method IS NOT NULL ORDER BY 1"
)
def _methods(le):
    return stats.facet(le, "http_method")


@query("facet_roles", "SELECT DISTINCT role AS value FROM conversations WHERE role IS NOT NULL ORDER BY 1", raw=True)
def _roles(spark, sf_dir):
    return stats.facet(table(spark, sf_dir, "conversations"), "role")


@entries_query(
    "prune_breakdown",
    "SELECT upper(level) AS level, count(*) AS count FROM le WHERE occurred_at < TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1",
)
def _breakdown(le):
    return stats.prune_breakdown(le, NOW, 10)


def stored_entries(spark, sf_dir, purpose: str) -> str:
    """The entries written as a table partitioned by day; returns its path."""
    path = scratch_path(spark, purpose)
    rows = add_previews(entries(spark, sf_dir), unit="chars")
    write_entries(conform(rows), path)
    return path


@query(
    "read_entries",
    f"SELECT {_ROW} FROM le WHERE occurred_at >= TIMESTAMP '2024-01-15 12:30:00' AND occurred_at <= TIMESTAMP '2024-01-30 23:59:59'",
)
def _read(spark, sf_dir):
    path = stored_entries(spark, sf_dir, "read")
    return read_entries(spark, path, MIDDLE, LATE).select(*_ROW_COLUMNS)


@query(
    "list_stored_table",
    f"SELECT {_ROW} FROM le WHERE {_BEFORE} AND level IN ('error','info') AND status='open' "
    "AND occurred_at >= TIMESTAMP '2024-01-08 00:00:00' ORDER BY occurred_at DESC, id DESC LIMIT 25",
)
def _list_table(spark, sf_dir):
    path = stored_entries(spark, sf_dir, "listed")
    page = list_table(
        spark, path, per_page=25, cursor=_CURSOR, levels=["error", "info"], from_="2024-01-08"
    )
    return page.rows.select(*_ROW_COLUMNS)


@query(
    "list_stored_meta",
    f"""SELECT least(count(*), 1000) AS count, count(*) > 1000 AS has_next_count, count(*) > 25 AS has_next,
      CASE WHEN count(*) > 25 THEN max(id) FILTER (WHERE place = 25) END AS last_id, 25 AS per_page
    FROM (SELECT id, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS place FROM le
      WHERE {_BEFORE} AND level IN ('error','info') AND status='open')""",
)
def _list_table_meta(spark, sf_dir):
    """The footer of the first stored page after a cursor, with the id its next cursor stands at."""
    path = stored_entries(spark, sf_dir, "footers")
    meta = list_table(spark, path, per_page=25, cursor=_CURSOR, levels=["error", "info"]).meta
    told = F.unbase64("next_cursor").cast("string")
    return meta.select(
        "count", "has_next_count", "has_next", F.get_json_object(told, "$.id").alias("last_id"), "per_page"
    )


@query(
    "newest_page",
    f"SELECT {_ROW} FROM le WHERE {_BEFORE} AND level='error' AND status='open' AND channel='stack' "
    "ORDER BY occurred_at DESC, id DESC LIMIT 40",
)
def _newest(spark, sf_dir):
    path = stored_entries(spark, sf_dir, "newest")
    page = newest_page(
        spark, path, per_page=40, cursor=_CURSOR, levels="error", channels="stack"
    )
    return page.select(*_ROW_COLUMNS)
