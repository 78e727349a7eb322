import base64
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsluice.functions.bounds import resolve, resolve_range, start_of
from logsluice.operators import filters as f
from logsluice.operators import paging, stats
from logsluice.operators.status import check_status, status_rows
from logsluice.plans.listing import list_entries

UUID = "550e8400-e29b-41d4-a716-446655440000"


@pytest.fixture(scope="module")
def rows(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [
        ("1", "error", "a", None, "open", UUID, 123, "127.0.0.1", "GET", at),
        ("2", "info", "b", "stack", "investigating", UUID, 12, "127.0.5.10", None, at + timedelta(days=1)),
        ("3", "debug", "c", "daily", "resolved", "650e8400", None, "10.0.0.1", "POST", at + timedelta(days=2)),
        ("4", "alert", "d", "slack", "ignored", None, 7, None, "PUT", at + timedelta(days=3)),
    ]
    schema = "id string, level string, message string, channel string, status string, trace_id string, user_id bigint, ip_address string, http_method string, occurred_at timestamp"
    return spark.createDataFrame(data, schema).cache()


def ids(df, condition=None):
    df = df if condition is None else df.where(condition)
    return sorted(r.id for r in df.collect())


def test_whole_values_and_prefixes(rows):
    assert ids(rows, f.trace_id(UUID)) == ["1", "2"]
    assert ids(rows, f.trace_id("550e8400")) == ["1", "2"]
    assert ids(rows, f.trace_id("e8400")) == []
    assert ids(rows, f.user_id(" 12 ")) == ["2"]
    assert ids(rows, f.user_id(123)) == ["1"]
    assert ids(rows, f.ip_address("127.")) == ["1", "2"]
    assert ids(rows, f.ip_address("127.0.0.1")) == ["1"]
    assert ids(rows, f.ip_address("::1")) == []
    for blank in ("", "   ", None):
        for test in (f.trace_id, f.user_id, f.ip_address):
            assert len(ids(rows, test(blank))) == 4


def test_rows_without_a_value_survive_exclusion(rows):
    assert ids(rows, f.exclude_channel("stack")) == ["1", "3", "4"]
    assert ids(rows, f.exclude_http_method(["GET", "PUT"])) == ["2", "3"]
    assert ids(rows, f.exclude_level(["error"])) == ["2", "3", "4"]


def test_status(rows):
    assert ids(rows, f.needs_attention()) == ["1", "2"]
    assert ids(rows, f.closed()) == ["3", "4"]
    assert ids(f.apply_filters(rows)) == ["1"]
    assert ids(f.apply_filters(rows, all_statuses=True)) == ["1", "2", "3", "4"]
    assert ids(f.apply_filters(rows, statuses=["resolved", "open"])) == ["1", "3"]
    assert [s[0] for s in status_rows({"x_y": {}})][-1] == "x_y"
    assert status_rows({"x_y": {}})[-1] == ("x_y", "X_y", "gray", False)
    with pytest.raises(ValueError):
        check_status("triaged")
    assert check_status("triaged", {"triaged": {}}) == "triaged"


def test_min_level(rows):
    assert ids(rows, f.min_level("error")) == ["1", "4"]


def test_pivot_shows_open_rows_unless_told(rows):
    assert ids(f.pivot(rows, "trace_id", UUID)) == ["1"]
    assert ids(f.pivot(rows, "trace_id", UUID, all_statuses=True)) == ["1", "2"]
    assert ids(f.pivot(rows, "user_id", 12, ("2024-01-01", "2024-01-01"), all_statuses=True)) == []


def test_date_range_is_inclusive(rows):
    assert ids(rows, f.date_range("2024-01-02", "2024-01-03")) == ["2", "3"]
    assert ids(rows, f.date_range("2024-01-02")) == ["2", "3", "4"]
    assert ids(rows, f.date_range(to="2024-01-02T01:00", tz="Europe/Berlin")) == ["1", "2"]
    with pytest.raises(ValueError):
        f.date_range("not a date")
    with pytest.raises(ValueError):
        f.date_range("2024-01-01", tz="Nowhere/City")


def test_bounds():
    now = datetime(2024, 3, 10, 15, 45, 30, tzinfo=timezone.utc)
    assert resolve("-1 hour", now=now) == datetime(2024, 3, 10, 14, 45, tzinfo=timezone.utc)
    assert resolve("-2 months", now=now) == now.replace(second=0) - timedelta(days=60)
    low, high = resolve_range("today", None, "America/New_York", now)
    # Clocks were put forward that day.
    assert low == datetime(2024, 3, 10, 5, tzinfo=timezone.utc)
    assert high == datetime(2024, 3, 11, 3, 59, tzinfo=timezone.utc)
    assert start_of("hour", now, "Asia/Kolkata") == datetime(2024, 3, 10, 15, 30, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        resolve("today")


@pytest.fixture(scope="module")
def many(spark):
    return (
        spark.range(1001)
        .select(
            F.lpad(F.col("id").cast("string"), 5, "0").alias("id"),
            F.lit("error").alias("level"),
            F.lit("open").alias("status"),
            # Every time three times, with fractions of a second.
            (F.lit("2024-01-01 00:00:00.000001").cast("timestamp_ntz")
             + F.make_dt_interval(secs=(F.floor(F.col("id") / 3) / 1000).cast("decimal(18,6)"))).alias("occurred_at"),
        )
        .cache()
    )


def test_pages_follow_on_without_gap_or_overlap(many):
    some = many.where("id < '00025'").cache()
    want = [r.id for r in paging.recent(some).collect()]
    got, cursor = [], None
    for _ in range(10):
        listing = list_entries(some, per_page=4, cursor=cursor)
        got += [r.id for r in listing.rows.collect()]
        meta = listing.meta.first()
        assert meta.per_page == 4
        assert meta["count"] == 25 - len(got) + len(listing.rows.collect())
        cursor = meta.next_cursor
        if not meta.has_next:
            break
    assert got == want and cursor is None


def test_capped_count(many):
    row = paging.capped_count(many).first()
    assert (row["count"], row.has_next_count) == (1000, True)
    row = paging.capped_count(many.where("id > '00000'")).first()
    assert (row["count"], row.has_next_count) == (1000, False)


def test_bad_cursors_are_ignored(many):
    odd = [
        None,
        "",
        "!!!invalid!!!",
        base64.b64encode(json.dumps({"foo": "bar"}).encode()).decode(),
        base64.b64encode(b"[1,2]").decode(),
        base64.b64encode(json.dumps({"occurred_at": "soon", "id": "1"}).encode()).decode(),
    ]
    for cursor in odd:
        assert paging.read_cursor(cursor) is None
        assert paging.after_cursor(many, cursor) is many


def test_page_size_is_clamped():
    assert [paging.clamp_per_page(n) for n in (None, 0, -5, 7, 1000)] == [50, 1, 1, 7, 100]


def test_empty_listing(many):
    listing = list_entries(many.limit(0))
    assert listing.rows.collect() == []
    meta = listing.meta.first()
    assert (meta.has_next, meta.next_cursor, meta["count"], meta.has_next_count) == (False, None, 0, False)


def test_empty_stats(many, now):
    total = stats.stats_total(many.limit(0), now).first()
    assert (total.total, total.by_level, total.today) == (0, "{}", 0)


def test_filters_reach_the_scan(spark, many, tmp_path):
    path = str(tmp_path / "t")
    many.withColumns(
        {"trace_id": F.lit(UUID), "ip_address": F.lit("10.1.1.1"), "user_id": F.lit(1).cast("bigint")}
    ).write.parquet(path)
    df = spark.read.parquet(path)
    where = f.date_range("2024-01-01", dtype=df.schema["occurred_at"].dataType)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df.where(
        where & f.trace_id(UUID) & f.ip_address("10.") & f.user_id("1") & f.level("error")
    ).select("id")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(trace_id", "StringStartsWith(ip_address,10.)", "EqualTo(user_id,1)", "EqualTo(level,error)", "GreaterThanOrEqual(occurred_at"):
        assert pushed in plan
