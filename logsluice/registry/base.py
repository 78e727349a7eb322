"""The driver tables seen as log data, and the list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# `events` ends on 2024-01-30; every time-relative query uses a fixed clock.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
LATE = datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)
MIDDLE = datetime(2024, 1, 15, 12, 30, tzinfo=timezone.utc)

# One text that Spark and DuckDB both run: events as log entries.
ENTRIES_SQL = """
SELECT lpad(CAST(event_id AS VARCHAR(26)), 26, '0') AS id,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'notice'
   WHEN 'purchase' THEN 'info' ELSE 'debug' END AS level,
 concat(event_type, ' failed: user ', CAST(user_id AS VARCHAR(20)), ' event ', CAST(event_id AS VARCHAR(20))) AS message,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS context,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'stack' WHEN 2 THEN 'daily' WHEN 3 THEN 'slack' ELSE 'deprecations' END AS channel,
 CASE WHEN event_type = 'error' THEN concat('/app/Services/S', CAST(user_id % 7 AS VARCHAR(5)), '.php') END AS source,
 CAST(CASE WHEN event_type = 'error' THEN event_id % 500 END AS INT) AS source_line,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat(
   substr(md5(CAST(event_id - event_id % 8 AS VARCHAR(20))),1,8),'-',
   substr(md5(CAST(event_id - event_id % 8 AS VARCHAR(20))),9,4),'-',
   substr(md5(CAST(event_id - event_id % 8 AS VARCHAR(20))),13,4),'-',
   substr(md5(CAST(event_id - event_id % 8 AS VARCHAR(20))),17,4),'-',
   substr(md5(CAST(event_id - event_id % 8 AS VARCHAR(20))),21,12)) END AS trace_id,
 CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS user_id,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('10.', CAST(user_id % 4 AS VARCHAR(5)), '.', CAST(user_id AS VARCHAR(5)), '.1') END AS ip_address,
 CAST(NULL AS VARCHAR(500)) AS user_agent,
 CASE event_id % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' WHEN 4 THEN 'DELETE' END AS http_method,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('https://app.example.com/', event_type, '?page=', CAST(event_id % 10 AS VARCHAR(5)), '&api_token=t', CAST(user_id AS VARCHAR(5))) END AS url,
 ts AS occurred_at,
 CASE event_id % 7 WHEN 0 THEN 'investigating' WHEN 1 THEN 'resolved' WHEN 2 THEN 'ignored' ELSE 'open' END AS status
FROM {events}
"""

_WITH_ENTRIES = "WITH le AS (" + ENTRIES_SQL.replace("{events}", "events") + ")\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRIES_SQL, events=table(spark, sf_dir, "events"))


def on_entries(sql: str) -> str:
    """DuckDB SQL over the entries: a SELECT, or further CTEs starting with a comma."""
    sql = sql.strip()
    return _WITH_ENTRIES + sql


def query(name: str, sql: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` runs over ``le`` unless ``raw``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip() if raw else on_entries(sql)
        return fn

    return add


def entries_query(name: str, sql: str):
    """Registers a function of the entries frame."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: fn(entries(spark, sf_dir)))
        return fn

    return add
