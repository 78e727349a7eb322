"""Rows that no operator may lose: without ids, rejected, refused, or with hostile contexts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsluice.functions.context import clean_context, redact_json
from logsluice.operators import triage
from logsluice.operators.failures import failures_since_dismiss
from logsluice.operators.requests import attach_request
from logsluice.operators.stats import quarter_counts, stats_by_level, stats_of_quarters
from logsluice.plans.capture import dedupe_capture
from logsluice.plans.changes import clear_stored, current_entries, fold_changes, record_changes
from logsluice.plans.listing import list_table, newest_page
from logsluice.operators.prepare import conform
from logsluice.sources.entries import append_entries, read_entries, rejects_path, write_entries
from logsluice.streaming.ingest import ingest_stream

START = datetime(2024, 1, 28, 10, tzinfo=timezone.utc)


def stored(spark, path, n=40):
    rows = [
        (f"{i:02}", "error" if i % 2 else "info", f"m{i}", START + timedelta(hours=i), "open", "app") for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id string, level string, message string, occurred_at timestamp, status string, channel string")
    write_entries(conform(df), path)
    return path


@pytest.mark.parametrize("with_id", [True, False])
def test_stream_keeps_rows_without_id_and_replays_them_alike(spark, tmp_path, now, with_id):
    source = str(tmp_path / "in")
    rows = spark.range(100).select(
        F.when(F.col("id") % 10 == 0, (F.col("id") % 50).cast("string")).alias("id"),
        F.lit("info").alias("level"),
        F.lit("same").alias("message"),
        F.lit(None).cast("string").alias("context"),
        F.lit("app").alias("channel"),
        F.when(F.col("id") % 3 > 0, F.lit(START)).alias("occurred_at"),
    )
    rows = rows if with_id else rows.drop("id")
    rows.coalesce(1).write.parquet(source)
    seen = []
    for turn in ("a", "b"):
        table, checkpoint = str(tmp_path / f"table-{turn}"), str(tmp_path / f"check-{turn}")
        records = spark.readStream.schema(rows.schema).parquet(source)
        ingest_stream(records, table, checkpoint, now, mode="queue").awaitTermination()
        found = read_entries(spark, table)
        assert found.count() == (95 if with_id else 100)
        assert found.select("id").distinct().count() == found.count()
        seen.append(found)


def test_late_files_are_stored_and_copies_told(spark, tmp_path, now):
    """Three files, each older than the one before; then all of them again, beside a new record."""
    source, table = str(tmp_path / "in"), str(tmp_path / "table")

    def arrive(hours, ids):
        spark.range(10).select(
            F.concat(F.lit(ids), F.col("id").cast("string")).alias("id"),
            F.lit("info").alias("level"),
            F.lit("said").alias("message"),
            F.lit(None).cast("string").alias("context"),
            F.lit("app").alias("channel"),
            F.lit(START + timedelta(hours=hours)).alias("occurred_at"),
        ).coalesce(1).write.mode("append").parquet(source)

    def run():
        records = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", "1")
        ingest_stream(records.parquet(source), table, str(tmp_path / "check"), now, mode="queue").awaitTermination()
        return sorted(r.id for r in read_entries(spark, table).collect())

    for hours, ids in ((0, "a"), (-5, "b"), (-10, "c"), (-400, "d")):
        arrive(hours, ids)
    want = [f"{x}{i}" for x in "abcd" for i in range(10)]
    assert run() == want
    for hours, ids in ((0, "a"), (-10, "c"), (-400, "d"), (-400, "e")):
        arrive(hours, ids)
    assert run() == want + [f"e{i}" for i in range(10)]
    assert not (tmp_path / "table-rejected").exists() or not list((tmp_path / "table-rejected").glob("batch=*"))


@pytest.mark.parametrize("channel", ["app", "deprecations"])
def test_a_stream_may_begin_with_batches_that_store_nothing(spark, tmp_path, now, channel):
    """A file without rows first, then one whose rows may all be left out, then others."""
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("id"),
        F.lit("info").alias("level"),
        F.lit("said").alias("message"),
        F.lit(None).cast("string").alias("context"),
        F.lit(channel).alias("channel"),
        F.lit(START).alias("occurred_at"),
    )
    for part in (rows.where("id < 0"), rows.where("id < 5"), rows):
        part.coalesce(1).write.mode("append").parquet(source)
        records = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(source)
        ingest_stream(records, table, str(tmp_path / "check"), now, mode="queue").awaitTermination()
    want = [str(i) for i in range(10)] if channel == "app" else []
    assert sorted(r.id for r in read_entries(spark, table).collect()) == want


def test_a_replayed_batch_does_not_take_itself_for_a_copy(spark, tmp_path, now):
    from logsluice.streaming.ingest import capture_batch

    table = str(tmp_path / "table")
    rows = spark.range(20).select(
        (F.col("id") % 15).cast("string").alias("id"),
        F.lit("info").alias("level"),
        F.lit("said").alias("message"),
        F.lit(None).cast("string").alias("context"),
        F.lit("app").alias("channel"),
        F.when(F.col("id") % 2 == 0, F.lit(START)).alias("occurred_at"),
    )
    for tag in ("x-1", "x-1", "x-2"):
        append_entries(capture_batch(rows, table, tag, now), table, now, batch=tag)
        assert read_entries(spark, table).count() == 15


def test_batch_dedupe_without_the_column(spark):
    rows = spark.createDataFrame([("x",), ("x",)], "message string")
    assert dedupe_capture(rows).count() == 2


def test_rejects_are_kept_whole(spark, tmp_path, now):
    table = str(tmp_path / "table")
    wide = "u" * 3000
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("id"),
        F.lit("info").alias("level"),
        F.when(F.col("id") % 3 > 0, F.lit("said")).alias("message"),
        F.lit(wide).alias("url"),
        F.lit(START).alias("occurred_at"),
    )
    for batch in (7, 7):  # a replay replaces
        append_entries(rows, table, now, batch=batch)
    kept = spark.read.parquet(rejects_path(table))
    good = read_entries(spark, table).where("message = 'said'")
    assert (good.count(), kept.count()) == (200, 100)
    assert {r.reason for r in kept.select("reason").distinct().collect()} == {"message is missing"}
    assert {r.url for r in good.select("url").distinct().collect()} == {wide}
    assert kept.select("id").distinct().count() == 100


def test_changes_clear_values_and_are_refused_loudly(spark, tmp_path):
    table, log = stored(spark, str(tmp_path / "t"), 6), str(tmp_path / "log")
    at = START + timedelta(days=5)
    schema = "id string, status string, changed_at timestamp, changed_by string, note string, by_given boolean, note_given boolean"

    def record(*rows):
        return record_changes(spark.createDataFrame(rows, schema), log).collect()

    assert record(("00", "resolved", at, "ann", "look", None, None), ("01", None, at, None, "only", None, None)) == []
    refused = record(
        ("02", "nonsense", at, None, None, None, None),
        ("03", "resolved", at, None, "x" * 10_001, None, None),
        (None, "resolved", at, None, None, None, None),
    )
    assert sorted(r.reason.split()[0] for r in refused) == ["id", "note", "status"]
    later = at + timedelta(hours=1)
    record(("00", "ignored", later, None, None, True, True))
    now_rows = {r.id: r for r in current_entries(spark, table, log).collect()}
    r = now_rows["00"]
    assert (r.status, r.status_changed_by, r.note) == ("ignored", None, None)
    r = now_rows["01"]
    assert (r.status, r.note, r.status_changed_at) == ("open", "only", None)
    assert now_rows["02"].status == now_rows["03"].status == "open"
    page = list_table(spark, table, log=log).rows
    assert "00" not in {r.id for r in page.collect()}
    fold_changes(spark, table, log)
    assert {(r.id, r.status) for r in read_entries(spark, table).where("id = '00'").collect()} == {("00", "ignored")}
    clear_stored(spark, table, log, statuses="ignored")
    assert {r.id for r in read_entries(spark, table).collect()} == {"01", "02", "03", "04", "05"}


def test_walking_all_pages(spark, tmp_path):
    table = stored(spark, str(tmp_path / "t"))
    seen, cursor = [], None
    while True:
        listing = list_table(spark, table, per_page=13, cursor=cursor)
        seen += [r.id for r in listing.rows.collect()]
        meta = listing.meta.first()
        if not meta.has_next:
            break
        cursor = meta.next_cursor
    assert seen == [f"{i:02}" for i in reversed(range(40))]
    first = newest_page(spark, table, per_page=2)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and ">= 2024-01-30)" in plan


def test_hostile_contexts(spark):
    deep = '{"a":' * 4000 + '{"password":1}' + "}" * 4000
    texts = {
        '{"m":"\\ud83d","password":"x"}': '{"m":"\\ud83d","password":"[REDACTED]"}',
        '{"token":"s","n":1e999,"k":12345678901234567890.50}': '{"token":"[REDACTED]","n":1e999,"k":12345678901234567890.50}',
        '{"x":NaN,"password":"p"}': '{"x":null,"password":"[REDACTED]"}',
        '{"a":1,"a":2,"password":3}': '{"a":1,"a":2,"password":"[REDACTED]"}',
        "no json, password": "no json, password",
        deep: '"[Max depth exceeded]"',
    }
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in rows.select("c", redact_json(F.col("c")).alias("r"), clean_context(F.col("c")).alias("k")).collect():
        assert r.r == texts[r.c]
        assert "password\":1" not in r.k


def test_a_trace_given_twice_counts_once(spark):
    logs = spark.createDataFrame([("1", "t"), ("2", "u")], "id string, trace_id string")
    requests = spark.createDataFrame(
        [("t", None, "b"), ("t", "10.0.0.2", None), ("t", "10.0.0.1", "z"), (None, "x", "x")],
        "trace_id string, ip_address string, url string",
    )
    rows = {r.id: r for r in attach_request(logs, requests).collect()}
    assert len(rows) == 2 and rows["1"].ip_address == "10.0.0.1" and rows["2"].url is None


@pytest.mark.parametrize("tz", ["UTC", "Asia/Kolkata"])
def test_counts_by_quarter_follow_the_clock(spark, tz):
    rows = spark.range(400).select(
        F.when(F.col("id") % 3 > 0, "info").otherwise("error").alias("level"),
        (F.lit(START) + F.expr("make_dt_interval(0, 0, 20 * int(id))")).alias("occurred_at"),
    )
    counts = quarter_counts(rows)
    for clock in (START + timedelta(hours=13, minutes=59), START + timedelta(hours=14, minutes=1), START + timedelta(days=3)):
        want = sorted(map(tuple, stats_by_level(rows, clock, tz).collect()))
        assert sorted(map(tuple, stats_of_quarters(counts, clock, tz).collect())) == want


def test_pauses_across_stretches(spark, monkeypatch):
    from logsluice.operators import failures

    monkeypatch.setattr(failures, "STRETCH", 3)
    times = [START + timedelta(minutes=m) for m in (0, 1, 9, 10, 11, 12, 13, 14, 15, 16)]
    rows = spark.createDataFrame([(t,) for t in times], "at timestamp")
    live = failures_since_dismiss(rows, None, 120, times[-1])
    assert sorted(r["at"].minute for r in live.collect()) == [9, 10, 11, 12, 13, 14, 15, 16]


def test_numbers_beyond_a_column_match_nothing(spark):
    from logsluice.operators.filters import user_id

    rows = spark.createDataFrame([(2**63 - 1,), (5,)], "user_id long")
    assert rows.where(user_id(2**63)).count() == 0 and rows.where(user_id(2**63 - 1)).count() == 1
    assert rows.where(~user_id(2**63)).count() == 2


def test_many_ids_take_the_same_way_as_few(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    assert triage.delete_many(rows, [str(i) for i in range(3, 5000)]).count() == 3


def more(spark, path, *ids, day=START):
    """Rows appended to the table while something else is going on."""
    rows = [(i, "info", "late", day, "open", "app") for i in ids]
    df = spark.createDataFrame(rows, "id string, level string, message string, occurred_at timestamp, status string, channel string")
    write_entries(conform(df), path)


def held(spark, path):
    return sorted(r.id for r in read_entries(spark, path).select("id").collect())


# Where a rewrite stops, and whether its change has come into effect by then.
STOPS = [("write", False), ("commit", False), ("settle", True), ("move", True), ("remove", True), ("mark", True)]


@pytest.mark.parametrize(("stop", "done"), STOPS)
def test_a_rewrite_stopped_anywhere_loses_and_revives_nothing(spark, tmp_path, monkeypatch, stop, done):
    from logsluice.plans.changes import delete_stored
    from logsluice.plans.retention import prune_table
    from logsluice.sources import commits, entries

    path = stored(spark, str(tmp_path / "t"))
    days = sorted(entries.stored_days(spark, path))

    def lost(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if stop == "write":
            m.setattr(entries, "commit", lost)
        elif stop == "commit":
            m.setattr(commits.json, "dumps", lost)
        elif stop == "settle":
            real, calls = commits.settle, []
            m.setattr(entries, "settle", lambda *a: real(*a) if len(calls) < 2 and not calls.append(1) else lost())
        elif stop == "move":
            real_plain, calls = commits._plain, []
            m.setattr(commits, "_plain", lambda s, n: real_plain(s, n) if len(calls) < 2 and not calls.append(1) else lost())
        elif stop == "remove":
            m.setattr(commits, "_drop_empty", lost)
        elif stop == "mark":
            m.setattr(commits, "drop_path", lost)
        with pytest.raises(OSError, match="lost"):
            entries.rewrite_days(spark, path, days, lambda rows: rows.where("id < '15' OR id = '39'"))
    before = [f"{i:02}" for i in range(40)]
    after = [i for i in before if i < "15" or i == "39"]
    assert held(spark, path) == (after if done else before)
    more(spark, path, "late", day=START + timedelta(hours=39))
    assert held(spark, path) == sorted([*(after if done else before), "late"])
    prune_table(spark, path, START + timedelta(hours=14, days=7), days=7)
    left = [i for i in (after if done else before) if i >= "14"] + ["late"]
    assert held(spark, path) == left
    delete_stored(spark, path, ["39"])
    commits.sweep(spark, path)
    assert held(spark, path) == [i for i in left if i != "39"]
    assert not [f for f in (tmp_path / "t" / "_commits").iterdir() if f.name.startswith("v-")]


def test_rows_appended_during_a_rewrite_stay(spark, tmp_path, monkeypatch):
    from logsluice.sources import commits, entries

    path = stored(spark, str(tmp_path / "t"))

    def change(rows):
        more(spark, path, "during")
        # Another rewrite comes first, and its files stay for now: this one must not undo it.
        if not seen:
            seen.append(1)
            with monkeypatch.context() as m:
                m.setattr(entries, "settle", lambda *a: None)
                entries.rewrite_days(spark, path, [START.date()], lambda r: r.where("id <> '03'"))
        return rows.where("id <> '01'")

    seen = []
    with pytest.raises(commits.ConcurrentRewrite):
        entries.rewrite_days(spark, path, [START.date()], change)
    assert "03" not in held(spark, path) and {"01", "during"} <= set(held(spark, path))
    entries.rewrite_days(spark, path, [START.date()], change)
    got = held(spark, path)
    assert got.count("during") == 2 and not {"01", "03"} & set(got) and len(got) == 40


def test_a_pending_change_is_read_with_day_pruning(spark, tmp_path, monkeypatch):
    from logsluice.sources import entries

    path = stored(spark, str(tmp_path / "t"))
    real, calls = entries.settle, []
    monkeypatch.setattr(entries, "settle", lambda *a: None if calls else calls.append(real(*a)))
    entries.rewrite_days(spark, path, [START.date()], lambda rows: rows.where("id <> '01'"))
    found = read_entries(spark, path, since=START + timedelta(days=1))
    assert "date" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert found.count() == 16 and len(held(spark, path)) == 39


def test_many_batches_become_one_folder_a_day(spark, tmp_path, now):
    from logsluice.sources import entries

    path = str(tmp_path / "t")
    for batch in range(4):
        rows = spark.range(5).select(
            F.concat(F.lit(str(batch)), F.col("id").cast("string")).alias("id"),
            F.lit("info").alias("level"),
            F.lit("m").alias("message"),
            F.lit(START).alias("occurred_at"),
        )
        append_entries(rows, path, now, batch=f"s-{batch}")
    before = {r.id for r in read_entries(spark, path).collect()}
    entries.compact_days(spark, path, [START.date()])
    assert {r.id for r in read_entries(spark, path).collect()} == before and len(before) == 20
    folders = list((tmp_path / "t" / "date=2024-01-28").glob("batch=*"))
    assert [f.name for f in folders] == ["batch=compact"]
