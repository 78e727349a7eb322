import json
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logsluice.functions import context as ctx
from logsluice.functions.text import cut_chars, head_bytes, preview
from logsluice.functions.url import redact_headers, redact_url
from logsluice.operators import legacy, prepare
from logsluice.operators.requests import attach_request
from logsluice.plans.capture import CaptureRules, build, capture, dedupe_capture
from logsluice.schema import ENTRY_SCHEMA, Limits


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("n", range(0, 14))
def test_head_bytes_never_cuts_a_character(spark, n):
    value = "aé€😀b"
    want = value.encode()[:n].decode(errors="ignore")
    assert one(spark, head_bytes(text(value), n)) == want


def test_previews(spark):
    assert one(spark, preview(text("a" * 1000))) == "a" * 497 + "..."
    assert one(spark, preview(text("a" * 500))) == "a" * 500
    assert one(spark, preview(text("é" * 300))) == "é" * 248 + "..."
    assert one(spark, preview(text("é" * 300), unit="chars")) == "é" * 300
    assert one(spark, preview(text(None))) is None
    assert one(spark, cut_chars(text("é" * 7), 5)) == "é" * 5 + "… [truncated]"


def test_prepare(spark, now):
    at = datetime(2024, 1, 5, 1, 2, 3, 999, tzinfo=timezone.utc)
    df = spark.createDataFrame(
        [("x" * 200, '{"a":1}', at, None), ("y" * 30, '{"long":"%s"}' % ("z" * 99), None, "ignored")],
        "message string, context string, occurred_at timestamp, status string",
    )
    limits = Limits(message_preview=20, message_inline=50, truncate_at=100)
    cut, capped = prepare.prepare_entries(df, now, limits).orderBy("message").collect()
    assert cut.message == "x" * 100 and cut.is_truncated
    assert cut.message_preview == "x" * 17 + "..."
    assert (cut.context, cut.context_preview, cut.status) == ('{"a":1}', '{"a":1}', "open")
    assert str(cut.occurred_at) == "2024-01-05 01:02:03"
    assert capped.context == '{"_truncated":true,"_original_size":110}' and capped.is_truncated
    assert capped.context_preview.startswith('{"long"') and capped.status == "ignored"
    assert str(capped.occurred_at) == str(capped.created_at) == "2024-01-31 00:00:00"
    assert len({cut.id, capped.id}) == 2 and len(cut.id) == 26


def test_ulid(spark):
    # Time part as in the published format's own example.
    df = spark.range(3).select(
        F.timestamp_millis(F.lit(1469918176385)).alias("t"), F.lit("same").alias("k"), "id"
    )
    by_key = [r.id for r in prepare.with_ulid(df, "t", ["k"]).collect()]
    assert len(set(by_key)) == 1 and by_key[0].startswith("01aryz6s41")
    assert set(by_key[0]) <= set("0123456789abcdefghjkmnpqrstvwxyz") and len(by_key[0]) == 26
    assert len({r.id for r in prepare.with_ulid(df, "t").collect()}) == 3


def test_conform(spark):
    full = spark.createDataFrame([("1", "m", True, "x")], "id string, message string, is_truncated boolean, extra string")
    sparse = spark.createDataFrame([("m2",)], "message string")
    rows = prepare.union_conformed(full, sparse)
    assert rows.columns == ENTRY_SCHEMA.names
    first, second = rows.orderBy("message").collect()
    assert first.is_truncated is True and second.is_truncated is False
    assert second.id is None and second.level is None


def test_legacy_round_trip(spark):
    at = datetime(2024, 1, 1)
    new = spark.createDataFrame(
        [("1", "resolved", at, "me"), ("2", "ignored", at, "you"), ("3", "open", None, None)],
        "id string, status string, status_changed_at timestamp, status_changed_by string",
    )
    assert legacy.upgrade_legacy(new) is new
    old = legacy.downgrade_legacy(new)
    assert set(old.columns) == {"id", "environment", "resolved_at", "resolved_by"}
    assert legacy.downgrade_legacy(old) is old
    back = legacy.upgrade_legacy(old).orderBy("id").collect()
    assert [(r.status, r.status_changed_by) for r in back] == [("resolved", "me"), ("open", None), ("open", None)]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://x.io/a?token=1&b=2", "https://x.io/a?token=%5BREDACTED%5D&b=2"),
        ("https://u:p@x.io:8080/a?My_Token=1#f", "https://x.io:8080/a?My_Token=%5BREDACTED%5D#f"),
        ("https://x.io/a#?token=1", "https://x.io/a#?token=1"),
        ("https://x.io/a?", "https://x.io/a"),
        ("https://u:p@x.io/a", "https://u:p@x.io/a"),
        ("/a?token=1", "/a?token=1"),
        ("x.io?token=1", "x.io?token=1"),
        ("https://x.io?q=a b&r=%C3%A9+1&e", "https://x.io?q=a+b&r=%C3%A9+1&e="),
        ("https://x.io/?f[token]=1&f[x]=2", "https://x.io/?f%5Btoken%5D=%5BREDACTED%5D&f%5Bx%5D=2"),
        ("https://x.io/?secret[a]=1&secret[b]=2", "https://x.io/?secret=%5BREDACTED%5D"),
        ("https://x.io/?a=1&b=2&a=3", "https://x.io/?a=3&b=2"),
        ("https://x.io/?l[]=1&l[]=2", "https://x.io/?l%5B%5D=1&l%5B%5D=2"),
        ("https://x.io/?s=*~&p=100%", "https://x.io/?s=%2A%7E&p=100%25"),
        ("https://x.io/?m=a@b.c", "https://x.io/?m=a%40b.c"),
        (None, None),
    ],
)
def test_redact_url(spark, url, want):
    assert one(spark, redact_url(text(url))) == want
    assert one(spark, redact_url(text(url), enabled=False)) == url


def test_redact_headers(spark):
    sent = F.create_map(F.lit("Cookie"), F.array(F.lit("c")), F.lit("X-Cookie"), F.array(F.lit("d")))
    assert one(spark, redact_headers(sent)) == {"Cookie": ["[REDACTED]"], "X-Cookie": ["d"]}


def cleaned(spark, value, **kw):
    given = value if isinstance(value, str) else json.dumps(value)
    return json.loads(one(spark, ctx.clean_context(text(given), **kw)))


def test_clean_context(spark):
    assert cleaned(spark, []) == [] and cleaned(spark, {}) == {}
    assert cleaned(spark, {"__psr_log": 1, "_internal": 2, "n": {"__kept": 3}}) == {"n": {"__kept": 3}}
    assert cleaned(spark, {"é": "ü", "n": [1, 2.5, None, True]}) == {"é": "ü", "n": [1, 2.5, None, True]}
    secret = {"Api_Token": {"a": 1}, "user": [{"password": "x", "name": "y"}]}
    hidden = {"Api_Token": "[REDACTED]", "user": [{"password": "[REDACTED]", "name": "y"}]}
    assert cleaned(spark, secret) == hidden
    assert cleaned(spark, secret, redact=False) == secret
    assert cleaned(spark, r'{"password":"x"}') == {"password": "[REDACTED]"}


def test_clean_context_depth(spark):
    def nest(depth, leaf):
        return {"k": nest(depth - 1, leaf)} if depth else leaf

    assert cleaned(spark, nest(6, 1)) == nest(6, 1)
    assert cleaned(spark, nest(7, 1)) == nest(7, "[Max depth exceeded]")
    assert cleaned(spark, nest(9, 1)) == nest(7, "[Max depth exceeded]")
    assert cleaned(spark, nest(11, 1), handler=True) == nest(11, 1)
    assert cleaned(spark, nest(12, 1), handler=True) == nest(11, {"_truncated": "Max depth exceeded"})


def test_clean_context_handler(spark):
    value = {"a": {"_internal_x": 1, "b": 2}, "t": "é" * 6000}
    assert cleaned(spark, value, handler=True) == {"a": {"b": 2}, "t": "é" * 5000 + "... [truncated]"}


def test_long_texts_are_not_looked_through_sign_by_sign():
    """Cleaning costs about what reading and writing the JSON costs; it was twenty times that."""
    given = json.dumps({"_internal": 1, "t": "y" * 300_000, "u": "é" * 50_000}, ensure_ascii=False)
    clean = ctx._shaper(("token",), ctx.INTERNAL_PREFIXES, True, ctx.HANDLER_DEPTH, ctx.TOO_DEEP_MARK, None)

    def least(run):
        seconds = []
        for _ in range(7):
            start = time.perf_counter()
            run()
            seconds.append(time.perf_counter() - start)
        return min(seconds)

    plain = least(lambda: json.dumps(json.loads(given), ensure_ascii=False))
    assert least(lambda: clean(given)) < 6 * plain
    assert json.loads(clean(given)) == {"t": "y" * 300_000, "u": "é" * 50_000}


def test_exception_in_context(spark):
    frames = [{"file": f"f{i}", "line": i, "args": ["secret"], "type": None} for i in range(12)]
    value = {"exception": {"_type": "exception", "class": "E", "trace": frames}}
    trace = cleaned(spark, value)["exception"]["trace"]
    assert trace == [{"file": f"f{i}", "line": i} for i in range(10)]
    assert json.loads(one(spark, ctx.slim_trace(text(json.dumps(frames))))) == trace


@pytest.mark.parametrize(
    "exception, want",
    [
        ({"class": "E", "file": "a", "line": 1, "trace": [{"file": "b", "line": 2}]}, ("a", 1)),
        ({"class": "ArgumentCountError", "file": "a", "line": 1, "trace": [{"file": "b", "line": 2}]}, ("b", 2)),
        ({"class": "ArgumentCountError", "file": "a", "line": 1, "trace": [{"file": "b"}]}, ("b", 1)),
        ({"class": "ArgumentCountError", "file": "a", "line": 1, "trace": [{"line": 5}]}, ("a", 1)),
        ({"class": "ArgumentCountError", "file": "a", "line": 1, "trace": []}, ("a", 1)),
        ({"class": "TypeError", "message": "f(): Argument #1", "file": "a", "line": 1, "trace": [{"file": "b", "line": 2}]}, ("b", 2)),
        ({"class": "TypeError", "message": "Return value", "file": "a", "line": 1, "trace": [{"file": "b", "line": 2}]}, ("a", 1)),
        ("not an exception", (None, None)),
        (None, (None, None)),
    ],
)
def test_source_from_exception(spark, exception, want):
    row = one(spark, ctx.source_from_exception(text(json.dumps({"exception": exception}))))
    assert tuple(row) == want


def test_merge_context(spark):
    def merged(context, extra, error=None):
        return one(spark, ctx.merge_context(text(context), text(extra), text(error)))

    assert merged('{"a":1,"b":2}', '{"b":{"x":1},"c":3}') == '{"a":1,"b":{"x":1},"c":3}'
    assert merged(None, '{"c":3}') == '{"c":3}'
    assert merged('{"a": 1}', None) == '{"a": 1}'
    assert merged("[]", '{"a":1}') == '{"a":1}'
    assert json.loads(merged('{"a":1}', None, 'E: "q"')) == {"a": 1, "_callback_error": 'E: "q"'}


def test_edits_copy_what_they_do_not_change(spark):
    def merged(context, extra):
        return one(spark, ctx.merge_context(text(context), text(extra)))

    deep = '{"a":' * 3000 + "1" + "}" * 3000
    long = "1" * 5000
    assert merged('{"a":1,"a":2}', '{"b":3}') == '{"a":1,"a":2,"b":3}'
    assert merged('{"a":1,"b":0,"a":2}', '{"a":9,"c":1.50,"c":1.60}') == '{"a":9,"b":0,"c":1.60}'
    assert merged(f'{{"n":{long},"f": 1.10 , "e":1E+2}}', '{"x":[1, 2]}') == f'{{"n":{long},"f":1.10,"e":1E+2,"x":[1, 2]}}'
    assert merged('{"s":"\\ud83d","\\u0061":1}', '{"a":"}{,\\""}') == '{"s":"\\ud83d","a":"}{,\\""}'
    assert merged(deep, '{"z":1}') == deep[:-1] + ',"z":1}'
    assert merged("no json", "neither") == "{}" and merged('{"a":NaN}', '{"b":1}') == '{"b":1}'
    dropped = ctx.drop_internal_keys(text('{"__a":{"x":[1,{"y":2}]},"n":1.10,"n":1e5,"\\u005f_b":3,"_internal_c":"}","k": { } }'))
    assert one(spark, dropped) == '{"n":1.10,"n":1e5,"k":{ }}'
    assert one(spark, ctx.drop_internal_keys(text('{"x": 1, "k": "__a"}'))) == '{"x": 1, "k": "__a"}'


def test_drop_internal_keys_and_values(spark):
    given = text('{"__a":1,"b":{"__c":2}}')
    assert one(spark, ctx.drop_internal_keys(given)) == '{"b":{"__c":2}}'
    assert one(spark, ctx.drop_internal_keys(text("[]"))) == "[]"
    assert one(spark, ctx.context_value(text('{"a":{"b":[7,8]}}'), "root.a.b[1]")) == "8"
    assert one(spark, ctx.context_value(text('{"a":1}'), "root")) == '{"a":1}'
    assert one(spark, ctx.context_value(text('{"a":1}'), "x.y")) is None


def test_attach_request(spark):
    logs = spark.createDataFrame([("1", "t"), ("2", None), ("3", "u")], "id string, trace_id string")
    requests = spark.createDataFrame(
        [("t", "1.2.3.4", "https://x.io/?token=1"), (None, "9.9.9.9", "https://x.io/")],
        "trace_id string, ip_address string, url string",
    )
    rows = attach_request(logs, requests).orderBy("id").collect()
    assert [(r.trace_id, r.ip_address) for r in rows] == [("t", "1.2.3.4"), (None, None), ("u", None)]
    assert rows[0].url == "https://x.io/?token=%5BREDACTED%5D"


@pytest.mark.parametrize(
    "message, channel, context, kept",
    [
        ("bridge toll refused with code 7", None, None, True),
        ("x", "app", '{"_internal": true}', False),
        ("Tariff winter-7 is deprecated since May", None, None, True),
        ("The second argument of trim_all is deprecated", "deprecations", None, False),
        ("a deprecation", "php-deprecations", None, False),
        ("the old ferry table is deprecated for us", "harbour", None, True),
        ("trim_all: y is deprecated in /vendor/tools.php on line 9", None, None, False),
        ("x IS DEPRECATED on line 42", None, None, True),
        ("_internal in the message", "app", "{}", True),
    ],
)
def test_capture_rules(spark, now, message, channel, context, kept):
    df = spark.createDataFrame(
        [("1", "info", message, channel, context)],
        "id string, level string, message string, channel string, context string",
    )
    rules = CaptureRules(deprecation_channels=["deprecations", "php-deprecations"])
    assert capture(df, now, rules).count() == int(kept)


def test_capture_null_channel_and_duplicates(spark, now):
    df = spark.createDataFrame(
        [("1", "a"), ("1", "a"), ("2", None), (None, "a"), (None, "a")], "id string, channel string"
    ).withColumns({"level": F.lit("info"), "message": F.lit("m"), "context": text(None)})
    assert dedupe_capture(df).count() == 4
    assert capture(df, now, CaptureRules(ignore_null_channel=True)).count() == 3


def test_capture_takes_the_source_from_the_exception(spark):
    context = '{"exception":{"class":"E","file":"/app/a.php","line":3},"password":"x"}'
    df = spark.createDataFrame([(context, "https://x.io/?cvv=1")], "context string, url string")
    row = build(df, CaptureRules()).first()
    assert (row.source, row.source_line) == ("/app/a.php", 3)
    assert json.loads(row.context)["password"] == "[REDACTED]" and "REDACTED" in row.url


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    from pyspark.sql import types as T

    from logsluice.operators.paging import cursor_column, read_cursor
    from logsluice.schema import epoch_micros, to_instant, to_second, to_wall

    old = spark.conf.get("spark.sql.session.timeZone")
    # The first one is skipped by New York's clocks, the last is before 1970.
    texts = ["2024-03-10 02:30:15.250000", "2024-11-03 01:30:00.000001", "1969-12-31 23:59:59.500000"]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.col("t").cast("timestamp_ntz"))
        df = df.withColumn("i", to_instant(F.col("w")))
        ntz, ts = T.TimestampNTZType(), T.TimestampType()
        rows = df.select(
            "t",
            epoch_micros(F.col("w"), ntz).alias("a"),
            epoch_micros(F.col("i"), ts).alias("b"),
            to_wall(F.col("i")).cast("string").alias("wall"),
            to_second(F.col("w"), ntz).cast("string").alias("sw"),
            to_wall(to_second(F.col("i"), ts)).cast("string").alias("si"),
            cursor_column(F.col("w"), F.col("t"), ntz).alias("c1"),
            cursor_column(F.col("i"), F.col("t"), ts).alias("c2"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for r in rows:
        moment = datetime.fromisoformat(r.t)
        delta = moment - datetime(1970, 1, 1)
        assert r.a == r.b == (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
        assert datetime.fromisoformat(r.wall) == moment
        assert r.sw == r.si == str(moment.replace(microsecond=0))
        assert r.c1 == r.c2 and read_cursor(r.c1) == (moment, r.t)


@pytest.mark.parametrize("handler", [False, True])
def test_the_shortcut_gives_what_the_full_pass_gives(spark, handler):
    import random

    from logsluice.functions import context as c

    rng = random.Random(1)
    words = ["a", "_internal", "__x", "Token", "_type", "k", "exception", "é"]

    def value(depth):
        kind = rng.choice(["dict", "list", "leaf", "leaf"]) if depth else "leaf"
        if kind == "dict":
            return {rng.choice(words): value(depth - 1) for _ in range(rng.randrange(3))}
        if kind == "list":
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return rng.choice([1, "x", None, "exception", "{[", "y" * 10_001])

    def chain(depth):
        return {"a": chain(depth - 1)} if depth else 1

    roots = [value(14) for _ in range(300)] + [chain(d) for d in range(16)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in roots if isinstance(v, (dict, list))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [json.loads(r[0]) for r in df.select(ctx.clean_context(F.col("t"), handler=handler)).collect()]
    keys = c.SENSITIVE_KEYS
    full = (
        c._shaper(keys, c.INTERNAL_PREFIXES, True, c.HANDLER_DEPTH, c.TOO_DEEP_MARK, c.HANDLER_TEXT)
        if handler
        else c._shaper(keys, c.INTERNAL_PREFIXES, False, c.PLAIN_DEPTH, c.TOO_DEEP, None)
    )
    assert got == [json.loads(full(t)) for t in texts]
