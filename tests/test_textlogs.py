import random
import re

import pytest
from pyspark.sql import functions as F

from logsluice.functions.records import HEADER, is_json, split_json_tail
from logsluice.sources import textlogs
from logsluice.sources.entries import read_entries


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def parse(spark, path, **kw):
    rows = textlogs.parse_log_text(spark, path, **kw).collect()
    return sorted(rows, key=lambda r: (r.occurred_at, r.message))


def test_simple_record(spark, tmp_path):
    path = write(
        tmp_path / "app.log",
        '[2024-01-15 10:30:45] local.ERROR: Card was declined {"user_id":123}',
    )
    (row,) = parse(spark, path)
    assert (row.level, row.message, row.environment) == ("error", "Card was declined", "local")
    assert (row.context, row.channel) == ('{"user_id":123}', "app")
    assert str(row.occurred_at) == "2024-01-15 10:30:45"


def test_stack_trace_stays_in_the_message(spark, tmp_path):
    path = write(
        tmp_path / "daily-2024-01-15.log",
        "junk before\n\n"
        '[2024-01-15 10:30:45] local.ERROR: Upload broke off {"exception":"[object] (E(code: 0): at /app/T.php:42)\n'
        "[stacktrace]\n#0 /vendor/C.php(54): App\\T->index()\n#1 {main}\"}\r\n"
        "[2024-01-15 10:30:46] local.INFO: Cache warmed up\n",
    )
    first, second = parse(spark, path)
    assert first.channel == "daily" and first.level == "error"
    assert "Upload broke off" in first.message and "#0 /vendor" in first.message
    assert first.message.endswith('#1 {main}"}') and first.context == "[]"
    assert (second.level, second.message) == ("info", "Cache warmed up")


def test_source_and_levels(spark, tmp_path):
    levels = "DEBUG INFO NOTICE WARNING ERROR CRITICAL ALERT EMERGENCY".split()
    text = "".join(f"[2024-01-15T10:30:45.5+02:00] local.{v}: in /app/U.php:123\n" for v in levels)
    rows = parse(spark, write(tmp_path / "x.log", text))
    assert [r.level for r in rows] == [v.lower() for v in levels]
    assert {(r.source, r.source_line) for r in rows} == {("/app/U.php", 123)}
    assert {str(r.occurred_at) for r in rows} == {"2024-01-15 08:30:45.500000"}


def test_zone_of_times_without_offset(spark, tmp_path):
    path = write(tmp_path / "x.log", "[2024-07-15 10:30:45] local.INFO: x\n")
    (row,) = parse(spark, path, tz="Europe/Berlin")
    assert str(row.occurred_at) == "2024-07-15 08:30:45"


def test_old_records_are_marked_and_unreadable_dates_counted(spark, tmp_path, now):
    text = (
        "[2024-01-10 10:00:00] local.INFO: Before the limit\n"
        "[2024-01-25 10:00:00] local.INFO: After the limit\n"
        "[2024-02-30 10:00:00] local.INFO: No such day\n"
        "[2024-01-26 10:00:00] local.INFO:\n"
    )
    path = write(tmp_path / "x.log", text)
    rows = parse(spark, path, now=now, days=7)
    assert [(r.message, r._skipped) for r in rows] == [
        ("Before the limit", True),
        ("After the limit", False),
        ("", False),
    ]
    assert textlogs.count_entries(textlogs.parse_log_text(spark, path)).first()["count"] == 3
    summary = textlogs.import_summary(textlogs.parse_all(spark, path, now, 7))
    total = summary.where("file IS NULL").first()
    assert (total.imported, total.skipped, total.unparsed) == (2, 1, 1)


def test_nothing_to_read(spark, tmp_path, now):
    assert textlogs.list_log_files(spark, str(tmp_path / "none")).count() == 0
    assert textlogs.parse_log_text(spark, str(tmp_path / "none" / "*.log")).count() == 0
    assert parse(spark, write(tmp_path / "empty.log", "")) == []
    with pytest.raises(FileNotFoundError):
        textlogs.import_logs(spark, str(tmp_path / "none.log"), str(tmp_path / "t"), now)
    assert not (tmp_path / "t").exists()


def test_list_log_files(spark, tmp_path):
    import os

    for i, name in enumerate(["a.log", "b.log", "c.txt"]):
        write(tmp_path / name, "x" * (i + 1))
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    rows = textlogs.list_log_files(spark, str(tmp_path)).collect()
    assert [(r.name, r.size) for r in rows] == [("b.log", 2), ("a.log", 1)]


def test_equal_records_get_ids_of_their_own_and_keep_them(spark, tmp_path, now):
    path = write(tmp_path / "x.log", "[2024-01-30 10:00:00] local.INFO: same\n" * 50)
    table = str(tmp_path / "table")
    textlogs.import_logs(spark, path, table, now)
    first = {r.id for r in read_entries(spark, table).collect()}
    textlogs.import_logs(spark, path, table, now, fresh=True)
    again = {r.id for r in read_entries(spark, table).collect()}
    assert len(first) == 50 and first == again


def plain_loop(text):
    """The records of one file by a loop over its lines."""
    header = re.compile(HEADER)
    records = []
    for line in text.split("\n"):
        line = line.rstrip(" \t\n\r\0\x0b")
        if header.match(line):
            records.append([line])
        elif records:
            records[-1].append(line)
    return [("\n".join(r)).rstrip() for r in records]


def texts_of(rng, odd, records=120):
    texts = {}
    for f in range(6):
        lines = ["junk", "", "more junk"] * rng.randrange(3)
        for i in range(records):
            lines.append(f"[2024-01-15 10:{i % 60:02}:00] local.INFO: é record {i} of {f}")
            lines += [f"#{j} frame" + "x" * rng.randrange(80) for j in range(rng.choice([0, 0, 1, 4, 12]))]
            lines += rng.choice([[], ["[stacktrace] \t", ""], ["[not a header"]])
            if odd:
                lines += rng.choice([[], [], ["[2", "[2024-01-15] no"], ["[1999-12-31 23:59:59] x.INFO: old"]])
        end = rng.choice(["\n", "\r\n"])
        texts[f"f{f}.log"] = end.join(lines) + rng.choice(["", end])
    # Only text without any record, over several splits.
    texts["junk.log"] = "no header here\n" * (3 * records)
    # One record over several splits.
    texts["long.log"] = "[2024-01-15 10:00:00] local.INFO: long\n" + "line\n" * (4 * records)
    texts["bare.log"] = "[2024-01-15 10:00:00] local.INFO:\n" * 30
    if odd:
        texts["cut.log"] = "024-01-15 10:00:00] local.INFO: half\n[2024-01-15 10:00:00] local.INFO: x\n[2"
        texts["twice.log"] = "[2024-01-15 10:00:00] local.INFO: x\n[2[2024-01-15 10:00:00] local.INFO: y\n"
    return texts


def with_small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: with_small_splits(spark, size)
    for n, value in old.items():
        spark.conf.set(n, value)


def compare(records, texts):
    rows = records.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.concat_ws("\n", "first", "rest").alias("text")
    ).collect()
    for name, text in texts.items():
        mine = sorted(r.text.rstrip() for r in rows if r.name == name)
        assert mine == sorted(plain_loop(text)), name


@pytest.mark.parametrize("split_bytes", ["100b", "203b", "1k", "64k"])
@pytest.mark.parametrize("odd", [False, True])
def test_records_do_not_depend_on_splits(spark, tmp_path, splits, split_bytes, odd):
    # Each split is a task: fewer records where splits are tiny.
    texts = texts_of(random.Random(len(split_bytes)), odd, 12 if split_bytes.endswith("b") else 60)
    for name, text in texts.items():
        write(tmp_path / name, text)
    splits(split_bytes)
    path = str(tmp_path / "*.log")
    records = textlogs.assemble_records(spark, path)
    compare(records, texts)
    # A record's place is its number in the file, whatever the splits.
    places = {}
    for r in records.select("path", "place").collect():
        places.setdefault(r.path, []).append(int(r.place))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_ids_do_not_depend_on_splits_and_other_files(spark, tmp_path, splits, now):
    for name, text in texts_of(random.Random(8), True, 20).items():
        write(tmp_path / name, text)
    ids = {}
    for size, pattern in (("150b", "*.log"), ("64k", "*.log"), ("64k", "f1.log")):
        splits(size)
        table = str(tmp_path / f"table-{size}-{len(pattern)}")
        textlogs.import_logs(spark, str(tmp_path / pattern), table, now, days=0)
        ids[size, pattern] = {(r.message, r.id) for r in read_entries(spark, table).collect()}
    assert ids["150b", "*.log"] == ids["64k", "*.log"] > ids["64k", "f1.log"]


def test_no_row_is_larger_than_a_record(spark, tmp_path, splits):
    """Files without a header of this century, and without any."""
    write(tmp_path / "old.log", "[1999-12-31 23:59:59] x.INFO: old\nmore\n" * 3000)
    write(tmp_path / "none.log", "no header\n" * 3000)
    splits("8k")
    pieces = textlogs.read_lines(spark, str(tmp_path / "old.log")).mapInArrow(
        textlogs._pieces, textlogs._PIECE_SCHEMA
    )
    assert pieces.agg(F.max(F.size("lines"))).first()[0] == 2
    records = textlogs.assemble_records(spark, str(tmp_path / "*.log"))
    assert records.count() == 3000 and records.agg(F.max(F.length("rest"))).first()[0] == 4


def test_compressed_files(spark, tmp_path):
    import gzip

    texts = texts_of(random.Random(3), False)
    for name, text in texts.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    records = textlogs.assemble_records(spark, str(tmp_path / "*.gz"))
    compare(records, {f"{n}.gz": t for n, t in texts.items()})


@pytest.mark.parametrize(
    "text, message, context",
    [
        ('m {"a": 1}  ', "m", '{"a": 1}'),
        ("m {}", "m", "[]"),
        ('m {"a":1} x', 'm {"a":1} x', "[]"),
        ('m {"a":1}\n#0 {main}', 'm {"a":1}\n#0 {main}', "[]"),
        ('m {"a":1} {"b":2}', 'm {"a":1} {"b":2}', "[]"),
        ('m {"a":1}] [{"b":2}', 'm {"a":1}] [{"b":2}', "[]"),
        ('m {"a":1},{"b":2}', 'm {"a":1},{"b":2}', "[]"),
        ('m{"a":1}', 'm{"a":1}', "[]"),
        ('m\n{"a":{"b":[1,2]}}', "m", '{"a":{"b":[1,2]}}'),
        ("", "", "[]"),
    ],
)
def test_json_tail(spark, text, message, context):
    row = spark.range(1).select(split_json_tail(F.lit(text)).alias("t")).first().t
    assert (row.message, row.context) == (message, context)


def test_is_json_reads_the_whole_text(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1},{"b":1}', "[1", "3", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(is_json(F.col("t")))
    assert [bool(r[0]) for r in rows.collect()] == [True, False, False, False, True, False]
