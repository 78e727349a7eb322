"""Triage, failures, retention and streams on tables of their own."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsluice.functions.ids import ulid, ulid_time
from logsluice.operators import failures as fl
from logsluice.operators import triage
from logsluice.plans.changes import find_stored, record_changes
from logsluice.plans.retention import effective_days, prune, prune_preview, prune_table
from logsluice.session import scratch_path
from logsluice.sources.entries import append_entries, jdbc_options, read_entries
from logsluice.streaming.follow import follow_files
from logsluice.streaming.heartbeat import heartbeat_stream
from logsluice.streaming.ingest import ingest_stream

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), "info" if i % 2 else "error", f"m{i}", None if i == 3 else "c", "open", T0 + timedelta(days=i)) for i in range(6)]
    return spark.createDataFrame(
        data, "id string, level string, message string, channel string, status string, occurred_at timestamp"
    ).cache()


def test_set_status_keeps_who_and_note_unless_given(rows, now):
    first = triage.set_status(rows, "1", "resolved", now, by="me", note="n")
    again = triage.set_status(first, "1", "ignored", now)
    row = again.where("id = '1'").first()
    assert (row.status, row.status_changed_by, row.note) == ("ignored", "me", "n")
    assert again.where("status = 'open'").count() == 5
    many = triage.set_status_many(again, ["1", "2"], "open", now)
    row = many.where("id = '1'").first()
    assert (row.status, row.status_changed_by, row.note) == ("open", None, "n")
    with pytest.raises(ValueError):
        triage.set_status(rows, "1", "unheard_of", now)
    with pytest.raises(ValueError):
        triage.set_note(rows, "1", "x" * 10_001)
    assert triage.set_note(first, "1", None).where("note IS NOT NULL").count() == 0


def test_change_log_equals_single_changes(spark, rows, now):
    changes = spark.createDataFrame(
        [
            ("1", "investigating", now, "a", "first"),
            ("1", "resolved", now + timedelta(hours=1), None, None),
            ("2", "unheard_of", now, "b", None),
            ("9", "resolved", now, "c", None),
        ],
        "id string, status string, changed_at timestamp, changed_by string, note string",
    )
    got = triage.apply_changes(rows, changes)
    want = triage.set_status(rows, "1", "investigating", now, "a", "first")
    want = triage.set_status(want, "1", "resolved", now + timedelta(hours=1))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_deletes(spark, rows):
    assert triage.delete(rows, "1").count() == 5
    assert triage.delete_many(rows, ["1", "2", "x"]).count() == 4
    assert triage.delete_many(rows, []).count() == 6
    lots = [str(i) for i in range(1, 3)] + [f"x{i}" for i in range(1000)]
    assert triage.delete_many(rows, lots).count() == 4
    assert triage.count_listed(rows, lots).first().deleted == 2
    assert triage.clear(rows, channels="c").count() == 1
    assert triage.clear(rows).count() == 0


def test_retention(rows):
    now = T0 + timedelta(days=33)
    assert effective_days(None, True) == 30 and effective_days(0, True) == 30
    assert effective_days(0, False) is None and effective_days(2, False) == 2
    kept = prune(rows, now)
    # The row exactly at the limit stays.
    assert sorted(r.id for r in kept.collect()) == ["3", "4", "5"]
    preview = prune_preview(rows, now)
    assert preview.total.first()["count"] + kept.count() == rows.count()
    assert [tuple(r) for r in preview.by_level.collect()] == [("ERROR", 2), ("INFO", 1)]
    off = prune_preview(rows, now, enabled=False)
    assert off.total.first()["count"] == 0 and off.by_level.count() == 0


@pytest.mark.parametrize("batches", [1, 2])
def test_prune_table(spark, rows, batches):
    path, now = scratch_path(spark, "prunetest"), T0 + timedelta(days=33, hours=1)
    for b in range(batches):
        part = rows.where(F.col("id") % batches == b)
        append_entries(part, path, now, batch=b if batches > 1 else None)
    # A second row on the day of the limit, later than the limit.
    late = rows.where("id = '3'").withColumns(
        {"id": F.lit("3b"), "occurred_at": F.col("occurred_at") + F.expr("INTERVAL 3 HOURS")}
    )
    append_entries(late, path, now, batch=7 if batches > 1 else None)
    prune_table(spark, path, now, enabled=False)
    assert read_entries(spark, path).count() == 7
    for _ in range(2):
        prune_table(spark, path, now)
        assert sorted(r.id for r in read_entries(spark, path).collect()) == ["3b", "4", "5"]


def test_days_are_utc_days_in_any_session_zone(spark, rows):
    path, old = scratch_path(spark, "zones"), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        late = rows.withColumn("occurred_at", F.col("occurred_at") + F.expr("INTERVAL 11 HOURS"))
        append_entries(late, path, T0)
        at = T0 + timedelta(days=2, hours=11)
        assert [r.id for r in read_entries(spark, path, at, at).collect()] == ["2"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_append_keeps_good_rows_and_shows_bad_ones(spark, now):
    good = spark.range(500).select(F.lit("info").alias("level"), F.lit("same").alias("message"))
    bad = spark.range(250).select(F.lit("error").alias("level"), F.lit(None).cast("string").alias("message"))
    path = scratch_path(spark, "mixed")
    append_entries(good.unionByName(bad), path, now)
    rows = read_entries(spark, path)
    assert rows.where("message = 'same'").count() == 500
    beats = rows.where("message = '(unknown message)'").orderBy("context").collect()
    assert len(beats) == 3 and {r.level for r in beats} == {"error"}
    assert sorted(int(r.context.split('"occurrence":')[1].rstrip("}")) for r in beats) == [1, 100, 200]
    assert rows.select("id").distinct().count() == 503


def failures(spark, n, key=lambda i: "E", at=lambda i: T0 + timedelta(seconds=i)):
    data = [(i, key(i), "f.php", 1, f"text {i}", "here", at(i)) for i in range(n)]
    return spark.createDataFrame(
        data, "id long, class string, file string, line int, error string, where string, at timestamp"
    )


@pytest.mark.parametrize("n, kept", [(25, [1]), (100, [1, 100]), (250, [1, 100, 200])])
def test_heartbeat(spark, n, kept):
    beats = fl.heartbeat(failures(spark, n), order=["at", "id"]).orderBy("at").collect()
    assert [r.occurrence for r in beats] == kept


def test_heartbeat_keys_ties_and_nulls(spark):
    df = failures(spark, 300, key=lambda i: [None, "A", "B"][i % 3], at=lambda i: T0)
    beats = fl.heartbeat(df, order=["at", "id"], every=50).collect()
    assert sorted((r["class"] or "", r.occurrence) for r in beats) == [
        (k, n) for k in ("", "A", "B") for n in (1, 50, 100)
    ]


def test_fallback_row_shortens_the_text(spark, now):
    df = failures(spark, 1).withColumn("error", F.repeat(F.lit("é"), 1500))
    row = fl.fallback_rows(df, "queue", now).first()
    assert row.level == "error" and row.message == "(unknown message)"
    assert "é" * 1000 + "… [truncated]" in row.context and "é" * 1001 not in row.context
    assert '"where":"queue"' in row.context and '"occurrence":1' in row.context


def test_summary(spark, now):
    df = failures(spark, 3, at=lambda i: T0 + timedelta(minutes=30 * i))
    row = fl.failure_summary(df.withColumn("error", F.repeat("error", 200))).first()
    assert row["count"] == 3 and row.first_at == T0.replace(tzinfo=None)
    assert len(row.last_message) <= 515
    assert fl.failure_summary(df.limit(0)).collect() == []
    after = fl.failures_since_dismiss(df, T0 + timedelta(minutes=30))
    assert [r.id for r in after.collect()] == [2]


@pytest.mark.parametrize(
    "minutes, ttl, now_minute, want",
    [
        ([0, 10, 20], 900, 30, [0, 1, 2]),
        ([0, 10, 20], 900, 36, []),
        ([0, 10, 40, 50], 900, 60, [2, 3]),
        ([0, 10, 40], 900, 20, [0, 1]),
        ([], 900, 20, []),
    ],
)
def test_failures_lapse(spark, minutes, ttl, now_minute, want):
    df = failures(spark, len(minutes), at=lambda i: T0 + timedelta(minutes=minutes[i])) if minutes else failures(spark, 1).limit(0)
    rows = fl.failures_since_dismiss(df, None, ttl, T0 + timedelta(minutes=now_minute))
    assert sorted(r.id for r in rows.collect()) == want


def test_retryable(spark):
    df = spark.createDataFrame([("08006",), ("40P01",), ("42000",), ("HY000",), (None,)], "code string")
    again, rest = fl.split_retryable(df)
    assert (again.count(), rest.count()) == (2, 3)


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "log_entries", T0, T0 + timedelta(days=1), 8)
    assert options["lowerBound"] == "2024-01-01 12:00:00" and options["numPartitions"] == "8"


def test_ingest_stream_over_several_batches(spark, rows, tmp_path, now):
    source, path = str(tmp_path / "in"), scratch_path(spark, "streamed")
    checkpoint = scratch_path(spark, "checkpoint")
    with_context = rows.withColumn("context", F.lit('{"api_key":"x"}'))
    # The same records come twice, and one of them cannot be stored.
    broken = with_context.withColumn("message", F.when(F.col("id") != "5", F.col("message")))
    for _ in range(2):
        broken.coalesce(1).write.mode("append").parquet(source)
        stream = ingest_stream(
            spark.readStream.schema(broken.schema).parquet(source), path, checkpoint, now, "queue",
        )
        stream.awaitTermination()
    got = read_entries(spark, path)
    assert sorted(r.message for r in got.collect()) == ["(unknown message)", "m0", "m1", "m2", "m3", "m4"]
    assert got.where("context = '{\"api_key\":\"[REDACTED]\"}'").count() == 5
    with pytest.raises(ValueError):
        ingest_stream(got, path, checkpoint, mode="later")


def test_heartbeat_stream_counts_on(spark, tmp_path):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "cp"))
    df = failures(spark, 240, key=lambda i: "AB"[i % 2])
    for part in (df.where("id < 130"), df.where("id >= 130")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = heartbeat_stream(
            spark.readStream.schema(df.schema).parquet(source), out, state, checkpoint, order=["at", "id"], every=50
        )
        stream.awaitTermination()
    got = sorted((r["class"], r.occurrence, r.id) for r in spark.read.parquet(out).collect())
    want = fl.heartbeat(df, order=["at", "id"], every=50).collect()
    assert got == sorted((r["class"], r.occurrence, r.id) for r in want) and len(got) == 6


def test_folds_take_changes_off_the_log(spark, rows, now, monkeypatch):
    from logsluice.plans import changes as pc

    path, log = scratch_path(spark, "folds"), scratch_path(spark, "date=1 of changes")
    append_entries(rows, path, T0)
    schema = "id string, status string, changed_at timestamp, changed_by string, note string, note_given boolean"
    made = [
        ("1", "resolved", now, "a", "first", None),
        ("1", None, now + timedelta(hours=2), None, None, True),
        ("1", "ignored", now + timedelta(hours=1), None, None, None),
        ("1", "open", now - timedelta(hours=1), "late", "older note", None),
        ("2", None, now, None, "only", None),
        ("1", None, now + timedelta(hours=1), "b", "cleared later", None),
    ]
    everything = spark.createDataFrame(made, schema)
    want = sorted(map(str, triage.apply_changes(read_entries(spark, path), everything).collect()))
    monkeypatch.setattr(pc, "MANY_FILES", 2)
    dropped = pc._drop_files
    for number, change in enumerate(made):
        record_changes(spark.createDataFrame([change], schema), log)
        if number == 2:
            continue  # Two changes in one fold.
        if number == 3:  # Stopped before it removes what it folded.
            monkeypatch.setattr(pc, "_drop_files", lambda spark, files: None)
        pc.fold_changes(spark, path, log)
        monkeypatch.setattr(pc, "_drop_files", dropped)
        here = triage.apply_changes(
            pc.read_entries(spark, path), spark.createDataFrame(made[: number + 1], schema)
        ).collect()
        assert sorted(map(str, pc.current_entries(spark, path, log).collect())) == sorted(map(str, here))
    assert pc._files(spark, log) == [] and pc.read_changes(spark, log) is None
    stored = read_entries(spark, path)
    assert sorted(map(str, stored.select(*triage.apply_changes(stored, everything).columns).collect())) == want
    kept = spark.read.parquet(pc.folded_path(log))
    assert triage.winning_changes(kept).where("id = '1'").count() <= 3
    files = read_entries(spark, path).inputFiles()
    pc.fold_changes(spark, path, log)
    assert read_entries(spark, path).inputFiles() == files
    plan = pc.current_entries(spark, path, log)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    everything.where("id = '2'").select("id", "status", "changed_at", "changed_by", "note").write.mode("append").parquet(log)
    assert find_stored(spark, path, "2", log).first().note == "only"


def test_runs_of_counters_cover_every_batch_once_and_survive_replays():
    from logsluice.streaming.heartbeat import FAN, live_runs, merged_at

    there = set()
    for batch in range(600):
        runs = live_runs(batch)
        covered = [b for level, first in runs for b in range(first, first + FAN**level)]
        assert covered == list(range(batch)) and len(runs) <= 7 * 4
        for _ in range(2):  # The second time is a replay after a crash at the end.
            there -= set(merged_at(batch - 1))
            assert there >= set(runs)
            there.add((0, batch))
            merged = merged_at(batch)
            for level, first in merged[::FAN]:
                assert there >= {run for run in merged if run[0] == level}
                there.add((level + 1, first))
    assert len(there) < 40


def test_heartbeat_stream_merges_counters_and_replays_a_batch(spark, tmp_path):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "cp"))
    df = failures(spark, 300, key=lambda i: f"k{i // 40}" if i % 2 else None)

    def run():
        rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(source)
        heartbeat_stream(rows, out, state, checkpoint, order=["at", "id"], every=20).awaitTermination()

    def beats():
        return sorted((str(r["class"]), r.occurrence, r.id) for r in spark.read.parquet(out).collect())

    for part in range(8):
        df.where(f"id >= {part * 30} AND id < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(source)
    run()
    first = beats()
    # The merging batch was not committed: it runs again.
    (tmp_path / "cp" / "commits" / "7").unlink()
    (tmp_path / "cp" / "commits" / ".7.crc").unlink(missing_ok=True)
    run()
    assert beats() == first
    for part in (8, 9):
        df.where(f"id >= {part * 30} AND id < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(source)
        run()
    want = fl.heartbeat(df, order=["at", "id"], every=20).collect()
    assert beats() == sorted((str(r["class"]), r.occurrence, r.id) for r in want)
    runs = sorted(p.relative_to(state).parts[1:] for p in (tmp_path / "state").glob("*/*/*"))
    assert runs == [("level=0", "first=8"), ("level=0", "first=9"), ("level=1", "first=0")]
    # A batch writes a counter for each of its own keys (two and null), not for all nine.
    assert spark.read.parquet(f"{next((tmp_path / 'state').iterdir())}/level=0/first=9").count() == 3


def test_list_table_scans_a_day_once_and_reads_the_page_by_id(spark, rows):
    from logsluice.operators.paging import page_meta, read_cursor
    from logsluice.plans.listing import list_table

    path = scratch_path(spark, "pages")
    append_entries(rows, path, T0)
    stored = read_entries(spark, path)
    cursor, seen = None, []
    while True:
        listing = list_table(spark, path, per_page=2, cursor=cursor)
        want, got = page_meta(stored, 2, cursor).first(), listing.meta.first()
        assert got.asDict() | {"next_cursor": read_cursor(got.next_cursor)} == want.asDict() | {
            "next_cursor": read_cursor(want.next_cursor)
        }
        seen += [r.id for r in listing.rows.collect()]
        if not got.has_next:
            break
        assert len({f.split("date=")[1][:10] for f in listing.rows.inputFiles()}) <= 6
        cursor = got.next_cursor
    assert seen == [r.id for r in stored.orderBy(F.desc("occurred_at"), F.desc("id")).collect()]
    empty = list_table(spark, path, levels="no such level")
    assert empty.rows.collect() == [] and empty.meta.first().asDict() == {
        "has_next": False, "next_cursor": None, "per_page": 50, "count": 0, "has_next_count": False,
    }


def test_follow_files_takes_new_files_once(spark, tmp_path, now):
    folder, table, checkpoint = tmp_path / "logs", str(tmp_path / "t"), str(tmp_path / "cp")
    folder.mkdir()
    for i in range(2):
        (folder / f"app [{i}].log").write_text(f"[2024-01-30 10:00:0{i}] local.INFO: m{i}\nmore\n")
        follow_files(spark, str(folder), table, checkpoint, now).awaitTermination()
    assert sorted(r.message for r in read_entries(spark, table).collect()) == ["m0\nmore", "m1\nmore"]


def test_newest_page_opens_only_the_days_it_needs(spark, rows):
    from logsluice.operators.paging import count_up_to, make_cursor
    from logsluice.plans.listing import newest_page

    path = scratch_path(spark, "pages")
    append_entries(rows, path, T0)
    first = newest_page(spark, path, per_page=2)
    assert [r.id for r in first.collect()] == ["5", "4"]
    days = {f.split("date=")[1][:10] for f in first.inputFiles()}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert len(days) == 6 and "date" in plan and "2024-01-03" in plan
    cursor = make_cursor(T0 + timedelta(days=4), "4")
    assert [r.id for r in newest_page(spark, path, 3, cursor).collect()] == ["3", "2", "1"]
    assert [r.id for r in newest_page(spark, path, 9, cursor, levels="info").collect()] == ["3", "1"]
    assert newest_page(spark, path, 9, from_="2025-01-01").collect() == []
    assert count_up_to(rows, 4) == (4, True) and count_up_to(rows, 6) == (6, False)


def test_channel_of_escaped_paths(spark):
    from logsluice.functions.records import channel_from_uri

    df = spark.createDataFrame(
        [("file:///x/my%20app+1-2024-01-05.log", "my app+1"), ("file:///a-2024-01-01/b.log", "b"), ("c.txt", "c.txt")],
        "path string, want string",
    )
    assert df.where(channel_from_uri(F.col("path")) != F.col("want")).count() == 0


def test_change_log_of_a_stored_table(spark, rows, now):
    from logsluice.plans.changes import current_entries, delete_stored, fold_changes, record_changes

    path, log = scratch_path(spark, "triaged"), scratch_path(spark, "log")
    for batch in range(2):
        append_entries(rows.where(F.col("id") % 2 == batch), path, now, batch=batch)
    schema = "id string, status string, changed_at timestamp, changed_by string, note string"
    record_changes(spark.createDataFrame([("1", "resolved", now, "me", "done")], schema), log)
    record_changes(spark.createDataFrame([("1", "ignored", now + timedelta(hours=1), None, None)], schema), log)
    want = sorted(current_entries(spark, path, log).collect())
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "date=2024-01-02" not in f}
    for _ in range(2):
        fold_changes(spark, path, log)
        assert sorted(read_entries(spark, path).select(current_entries(spark, path, log).columns).collect()) == want
    changed = [r for r in want if r.id == "1"]
    assert [(r.status, r.status_changed_by, r.note) for r in changed] == [("ignored", "me", "done")]
    # Files of other days are the ones written first.
    assert untouched <= set(spark.read.parquet(path).inputFiles())
    delete_stored(spark, path, ["1", "2", "absent"])
    delete_stored(spark, path, [])
    assert sorted(r.id for r in read_entries(spark, path).collect()) == ["0", "3", "4", "5"]


def test_a_hot_key_is_spread_over_tasks(spark):
    df = failures(spark, 2000, at=lambda i: T0 + timedelta(seconds=10 * i))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        numbered = fl.occurrences(df, order=["at", "id"]).withColumn("task", F.spark_partition_id())
        tasks = numbered.groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 700
    assert sorted(r.occurrence for r in numbered.collect()) == list(range(1, 2001))


def test_one_hot_instant_is_spread_over_tasks(spark):
    """Failures of one key and one instant, some without a text: parts keep the order of numbers."""
    df = spark.range(0, 40_000, 1, 8).select(
        "id",
        F.lit("E").alias("class"),
        F.lit("f.php").alias("file"),
        F.lit(1).alias("line"),
        F.when(F.col("id") % 1000 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("error"),
        F.lit(T0).alias("at"),
    )
    order = ["at", "error", "id"]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        numbered = fl.occurrences(df, order=order, hot_rows=1000)
        rows = numbered.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    tasks = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(tasks) == 8 and max(tasks) < 15_000
    want = sorted(rows, key=lambda r: (r.error is not None, r.error or "", r.id))
    assert [r.occurrence for r in want] == list(range(1, 40_001))
    before = spark.createDataFrame([("E", "f.php", 1, 5)], "class string, file string, line int, n long")
    later = fl.occurrences(df, order=order, before=before, hot_rows=1000)
    assert later.agg(F.min("occurrence"), F.max("occurrence"), F.count_distinct("occurrence")).first()[:] == (6, 40_005, 40_000)


def test_changes_of_one_moment_are_taken_whole(spark, now):
    data = [("1", "resolved", now, by, note) for by, note in [("a", "z"), ("c", "x"), ("b", None), (None, "y")]]
    frame = spark.createDataFrame(data, "id string, status string, changed_at timestamp, changed_by string, note string")
    for parts in (1, 2, 4):
        (row,) = triage.latest_status(frame.repartition(parts)).collect()
        assert (row.status, row.changed_by, row.note) == ("resolved", "c", "x")


def test_a_stored_entry_is_found_on_the_day_its_id_tells(spark, now):
    def millis(day):
        return F.lit(int((T0 + timedelta(days=day)).timestamp() * 1000))

    path, log = scratch_path(spark, "by-id"), scratch_path(spark, "by-id-log")
    ids = [spark.range(1).select(ulid(millis(day), [F.lit(day)])).first()[0] for day in range(4)]
    data = [(i, "error", f"m{n}", T0 + timedelta(days=n)) for n, i in enumerate(ids)]
    data += [("other", "info", "m9", T0), (ids[3].replace(ids[3][-1], "0"), "info", "moved", T0)]
    frame = spark.createDataFrame(data, "id string, level string, message string, occurred_at timestamp")
    append_entries(frame, path, now)
    assert ulid_time(ids[2]) == T0 + timedelta(days=2)
    assert ulid_time("other") is None and ulid_time("7" + "z" * 25) is None and ulid_time("8" + "0" * 25) is None
    for entry_id, _, message, _ in data:
        assert [r.message for r in find_stored(spark, path, entry_id).collect()] == [message]
    assert {f.split("date=")[1][:10] for f in find_stored(spark, path, ids[2]).inputFiles()} >= {"2024-01-03"}
    assert "2024-01-03" in find_stored(spark, path, ids[2])._jdf.queryExecution().executedPlan().toString()
    assert find_stored(spark, path, "absent").count() == 0
    changed = [(ids[1], "resolved", now, "me", "seen")]
    record_changes(
        spark.createDataFrame(changed, "id string, status string, changed_at timestamp, changed_by string, note string"), log
    )
    (row,) = find_stored(spark, path, ids[1], log).collect()
    assert (row.status, row.note, row.message) == ("resolved", "seen", "m1")
    assert [r.status for r in find_stored(spark, path, ids[0], log).collect()] == ["open"]


def test_user_ids_beyond_bigint_match_nothing(rows):
    from logsluice.operators.filters import user_id

    df = rows.withColumn("user_id", F.lit(5).cast("bigint"))
    assert df.where(user_id("9" * 30)).count() == 0


def test_a_second_stream_overwrites_nothing(spark, rows, tmp_path, now):
    source, path = str(tmp_path / "in"), scratch_path(spark, "streamed")
    rows.withColumn("context", F.lit(None).cast("string")).coalesce(1).write.parquet(source)
    for n in range(2):
        schema = spark.read.parquet(source).schema
        stream = ingest_stream(
            spark.readStream.schema(schema).parquet(source), path, str(tmp_path / f"cp{n}"), now, "queue",
            dedupe_key=None,
        )
        stream.awaitTermination()
    assert read_entries(spark, path).count() == 12
    prune_table(spark, path, T0 + timedelta(days=33, hours=1))
    assert sorted(r.id for r in read_entries(spark, path).collect()) == ["4", "4", "5", "5"]
