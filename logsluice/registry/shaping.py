"""Row shaping: previews, limits, defaults, ids, JSON contexts, URLs, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.functions import context as ctx
from logsluice.functions.text import preview
from logsluice.functions.url import redact_headers, redact_url
from logsluice.operators import legacy, prepare
from logsluice.operators.requests import attach_request
from logsluice.plans.capture import CaptureRules, capture, dedupe_capture
from logsluice.registry.base import NOW, entries, entries_query, query, table
from logsluice.schema import Limits

# DuckDB: the longest beginning of `text` with at most {n} bytes.
_HEAD = (
    "left(text, CAST(list_max(list_filter(range({low}, {n} + 1), lambda k: strlen(left(text, k)) <= {n})) AS BIGINT))"
)


def _head(n: int) -> str:
    return _HEAD.format(n=n, low=n // 4 - 1)


@query(
    "preview_bytes",
    f"SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE {_head(297)} || '...' END AS preview FROM documents",
    raw=True,
)
def _preview_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", preview(F.col("text"), 300).alias("preview")
    )


@query(
    "preview_chars",
    "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 497) || '...' END AS preview FROM documents",
    raw=True,
)
def _preview_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", preview(F.col("text"), 500, "chars").alias("preview")
    )


@query(
    "truncate_message",
    f"""SELECT doc_id, CASE WHEN strlen(text) > 1000 THEN {_head(1000)} ELSE text END AS message, strlen(text) > 400 AS is_truncated
    FROM documents""",
    raw=True,
)
def _truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    cut = prepare.truncate_message(docs, Limits(message_inline=400, truncate_at=1000))
    return cut.select("doc_id", "message", "is_truncated")


@entries_query(
    "cap_context",
    """SELECT id, CASE WHEN strlen(context) > 8 THEN '{"_truncated":true,"_original_size":' || CAST(strlen(context) AS VARCHAR) || '}' ELSE context END AS context,
    coalesce(strlen(context) > 8, false) AS is_truncated FROM le""",
)
def _cap(le):
    return prepare.cap_context(le, Limits(truncate_at=8)).select("id", "context", "is_truncated")


@entries_query(
    "fill_defaults",
    """SELECT id, date_trunc('second', CASE WHEN level = 'info' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE occurred_at END) AS occurred_at,
    coalesce(nullif(status, 'ignored'), 'open') AS status, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM le""",
)
def _defaults(le):
    gaps = le.withColumns(
        {
            "occurred_at": F.when(F.col("level") != "info", F.col("occurred_at")),
            "status": F.nullif(F.col("status"), F.lit("ignored")),
        }
    )
    return prepare.fill_defaults(gaps, NOW).select("id", "occurred_at", "status", "created_at")


_TO_ULID = "translate(lower(to_base({0}, 32, {1})), 'ijklmnopqrstuv', 'jkmnpqrstvwxyz')"


@entries_query(
    "with_ulid",
    ", h AS (SELECT *, sha256(message || chr(1) || level) AS h FROM le) SELECT message, "
    + _TO_ULID.format("epoch_us(occurred_at) // 1000", 10)
    + " || "
    + _TO_ULID.format("CAST('0x' || h[1:10] AS BIGINT)", 8)
    + " || "
    + _TO_ULID.format("CAST('0x' || h[11:20] AS BIGINT)", 8)
    + " AS id FROM h",
)
def _ulid(le):
    return prepare.with_ulid(le, "occurred_at", ["message", "level"]).select("message", "id")


@entries_query(
    "prepare_entries",
    """SELECT id, CASE WHEN strlen(message) <= 30 THEN message ELSE left(message, 27) || '...' END AS message_preview, message,
    context, context AS context_preview, date_trunc('second', occurred_at) AS occurred_at, strlen(message) > 32 AS is_truncated,
    status, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM le""",
)
def _prepare(le):
    rows = prepare.prepare_entries(le, NOW, Limits(message_preview=30, message_inline=32))
    return rows.select(
        "id", "message_preview", "message", "context", "context_preview", "occurred_at",
        "is_truncated", "status", "created_at",
    )


@query(
    "union_conformed",
    """SELECT id, level, message, channel, NULL::VARCHAR AS note, false AS is_truncated FROM le WHERE level = 'error'
    UNION ALL SELECT id, NULL, message, NULL, 'sparse', false FROM le WHERE level <> 'error'""",
)
def _conform(spark, sf_dir):
    le = entries(spark, sf_dir)
    full = le.where("level = 'error'").withColumn("is_truncated", F.lit(False))
    sparse = le.where("level <> 'error'").select("id", "message", F.lit("sparse").alias("note"))
    both = prepare.union_conformed(full, sparse)
    return both.select("id", "level", "message", "channel", "note", "is_truncated")


_LEGACY = """, old AS (SELECT id, CASE WHEN status = 'resolved' THEN occurred_at END AS resolved_at,
    CASE WHEN status = 'resolved' AND user_id IS NOT NULL THEN concat('user ', CAST(user_id AS VARCHAR)) END AS resolved_by FROM le)
"""


def _old(le):
    resolved = F.col("status") == "resolved"
    who = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return le.select(
        "id",
        "level",
        F.when(resolved, F.col("occurred_at")).alias("resolved_at"),
        F.when(resolved & F.col("user_id").isNotNull(), who).alias("resolved_by"),
        F.lit("production").alias("environment"),
    )


@entries_query(
    "upgrade_legacy",
    _LEGACY
    + """SELECT id, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' ELSE 'open' END AS status,
    resolved_at AS status_changed_at, resolved_by AS status_changed_by FROM old""",
)
def _upgrade(le):
    return legacy.upgrade_legacy(_old(le)).drop("level")


@entries_query(
    "downgrade_legacy",
    _LEGACY + "SELECT id, NULL::VARCHAR AS environment, resolved_at, resolved_by FROM old",
)
def _downgrade(le):
    return legacy.downgrade_legacy(legacy.upgrade_legacy(_old(le))).drop("level")


@entries_query(
    "to_json_rows",
    "SELECT to_json({'id': id, 'level': level, 'channel': channel, 'user_id': user_id})::VARCHAR AS json FROM le",
)
def _json_rows(le):
    return prepare.to_json_rows(le.select("id", "level", "channel", "user_id"))


@entries_query("context_value", "SELECT id, json_extract_string(context, '$.k') AS k FROM le")
def _value(le):
    return le.select("id", ctx.context_value(F.col("context"), "root.k").alias("k"))


@entries_query(
    "context_value_nested",
    """SELECT id, CAST(source_line AS VARCHAR) AS line, source AS file FROM le WHERE source IS NOT NULL""",
)
def _nested_value(le):
    text = F.to_json(
        F.struct(F.struct(F.array(F.struct("source_line", "source")).alias("frames")).alias("e"))
    )
    return le.where("source IS NOT NULL").select(
        "id",
        ctx.context_value(text, "e.frames[0].source_line").alias("line"),
        ctx.context_value(text, "root.e.frames[0].source").alias("file"),
    )


# --- URLs and headers -----------------------------------------------------------


@query(
    "redact_url_pages",
    r"SELECT page_id, regexp_replace(url, '([?&][^=&#]*(?:ref|utm)[^=&#]*=)[^&#]*', '\1%5BREDACTED%5D', 'g') AS url FROM pages",
    raw=True,
)
def _page_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", redact_url(F.col("url"), ["ref", "utm"]).alias("url"))


@entries_query(
    "redact_url_entries",
    r"SELECT id, regexp_replace(url, 'api_token=[^&#]*', 'api_token=%5BREDACTED%5D') AS url FROM le",
)
def _entry_urls(le):
    return le.select("id", redact_url(F.col("url")).alias("url"))


@entries_query(
    "redact_headers",
    """SELECT id, '{"Accept":["' || level || '"],"Cookie":["[REDACTED]"],"X-CSRF-Token":["[REDACTED]"]}' AS headers FROM le""",
)
def _headers(le):
    sent = F.create_map(
        F.lit("Accept"), F.array("level"),
        F.lit("Cookie"), F.array("id", "message"),
        F.lit("X-CSRF-Token"), F.array("trace_id"),
    )
    return le.select("id", F.to_json(redact_headers(sent)).alias("headers"))


# --- JSON contexts --------------------------------------------------------------


@entries_query(
    "redact_json",
    """SELECT id, '{"User_Password":"[REDACTED]","n":' || CAST(user_id AS VARCHAR) || ',"deep":[{"token":"[REDACTED]","k":"'
       || level || '"}]}' AS context FROM le WHERE user_id IS NOT NULL
    UNION ALL SELECT id, context FROM le WHERE user_id IS NULL""",
)
def _redact_json(le):
    secret = F.concat(
        F.lit('{"User_Password":"p'), "id", F.lit('","n":'), F.col("user_id").cast("string"),
        F.lit(',"deep":[{"token":{"a":1},"k":"'), "level", F.lit('"}]}'),
    )
    given = F.coalesce(secret, F.col("context"))
    return le.select("id", given.alias("context")).select(
        "id", ctx.redact_json(F.col("context")).alias("context")
    )


@entries_query(
    "drop_internal_keys",
    """SELECT id, '{"a":"' || level || '"}' AS context FROM le WHERE level <> 'debug' UNION ALL SELECT id, context FROM le WHERE level = 'debug'""",
)
def _internal_keys(le):
    text = F.concat(
        F.lit('{"__psr_log":1,"a":"'), "level", F.lit('","_internal_x":{"b":2}}')
    )
    given = F.when(F.col("level") != "debug", text).otherwise(F.col("context"))
    return le.select("id", ctx.drop_internal_keys(given).alias("context"))


@entries_query(
    "slim_trace",
    """SELECT id, '[' || array_to_string(list_transform(range(0, least(CAST(right(id, 2) AS BIGINT) % 15, 10)),
       lambda i: '{"file":"f' || CAST(i AS VARCHAR) || '.php","line":' || CAST(i AS VARCHAR) || ',"function":"run"}'), ',') || ']' AS trace FROM le""",
)
def _slim(le):
    size = (F.substring("id", -2, 2).cast("int") % 15).cast("int")
    frames = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(15)), F.lit(1), size),
        lambda i: F.struct(
            F.concat(F.lit("f"), i.cast("string"), F.lit(".php")).alias("file"),
            i.alias("line"),
            F.lit("run").alias("function"),
            F.array(F.lit("secret")).alias("args"),
        ),
    )
    return le.select("id", ctx.slim_trace(F.to_json(frames)).alias("trace"))


@entries_query(
    "source_from_exception",
    """SELECT id, CASE WHEN level = 'error' OR level = 'debug' THEN 'caller.php' WHEN level = 'info' OR level = 'notice' THEN 'callee.php' END AS source,
    CASE WHEN level = 'error' OR level = 'debug' THEN 7 WHEN level = 'info' OR level = 'notice' THEN 3 END AS source_line FROM le""",
)
def _exception_source(le):
    kind = (
        F.when(F.col("level") == "error", F.lit("ArgumentCountError"))
        .when(F.col("level").isin("debug", "info"), F.lit("TypeError"))
        .when(F.col("level") == "notice", F.lit("RuntimeException"))
    )
    said = F.when(F.col("level") == "debug", F.lit("f(): Argument #1")).otherwise(F.lit("no"))
    exception = F.struct(
        kind.alias("class"),
        said.alias("message"),
        F.lit("callee.php").alias("file"),
        F.lit(3).alias("line"),
        F.array(F.struct(F.lit("caller.php").alias("file"), F.lit(7).alias("line"))).alias("trace"),
    )
    text = F.when(kind.isNotNull(), F.to_json(F.struct(exception.alias("exception")))).otherwise(
        F.col("context")
    )
    return le.select("id", ctx.source_from_exception(text).alias("at")).select("id", "at.*")


@entries_query(
    "merge_context",
    """SELECT id, CASE WHEN level = 'error' THEN
        CASE WHEN context IS NULL THEN '{"_callback_error":"TypeError: no id"}'
             ELSE '{"k":' || json_extract_string(context, '$.k') || ',"_callback_error":"TypeError: no id"}' END
      WHEN level = 'info' THEN '{"k":"new","tenant":' || CAST(length(message) AS VARCHAR) || '}'
      WHEN context IS NULL THEN NULL ELSE context END AS context
    FROM le""",
)
def _merge(le):
    extra = F.when(
        F.col("level") == "info",
        F.concat(F.lit('{"k":"new","tenant":'), F.length("message").cast("string"), F.lit("}")),
    )
    error = F.when(F.col("level") == "error", F.lit("TypeError: no id"))
    return le.select("id", ctx.merge_context(F.col("context"), extra, error).alias("context"))


# Contexts that a map or a number type would change: repeated keys, long and padded numbers, half a character.
_AS_WRITTEN = r'"n":12345678901234567890123456789012345678901234567890,"f":1.10,"n":0,"s":"\ud83d"'


@entries_query(
    "merge_as_written",
    r"""SELECT id, CASE WHEN level = 'error' THEN '{' || '%s' || ',"__p":[1, 2],"tenant":"' || id || '"}'
      WHEN level = 'info' THEN '{' || '%s' || '}' WHEN level = 'debug' THEN '{"n":true,"f":1.10,"s":"\ud83d"}'
      ELSE context END AS context FROM le"""
    % (_AS_WRITTEN, _AS_WRITTEN),
)
def _merge_as_written(le):
    given = F.concat(F.lit("{" + _AS_WRITTEN), F.when(F.col("level") != "debug", ',"__p":[1, 2]').otherwise(""), F.lit("}"))
    context = F.when(F.col("level").isin("error", "info", "debug"), given).otherwise(F.col("context"))
    extra = F.when(F.col("level") == "error", F.concat(F.lit('{"tenant": "'), "id", F.lit('"}'))).when(
        F.col("level") == "debug", F.lit('{"n": true}')
    )
    merged = ctx.merge_context(context, extra)
    return le.select("id", F.when(F.col("level") == "info", ctx.drop_internal_keys(merged)).otherwise(merged).alias("context"))


@entries_query(
    "capture_enriched_as_written",
    r"""SELECT id, '{' || '%s' || ',"tenant":' || CAST(length(message) AS VARCHAR) || '}' AS context FROM le
    WHERE channel IS NULL OR channel <> 'deprecations'"""
    % _AS_WRITTEN,
)
def _capture_as_written(le):
    from logsluice.plans.capture import CaptureRules, capture
    from logsluice.registry.base import NOW

    def enrich(rows):
        return rows.withColumn("extra_context", F.concat(F.lit('{"tenant":'), F.length("message").cast("string"), F.lit("}")))

    given = le.withColumn("context", F.lit("{" + _AS_WRITTEN + "}"))
    return capture(given, NOW, CaptureRules(enrich=enrich)).select("id", "context")


@entries_query(
    "clean_context",
    """SELECT id, CASE WHEN level = 'debug' THEN context ELSE
      '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"[Max depth exceeded]"}}}}}},"exception":{"_type":"exception","class":"E","trace":[{"file":"x","line":1}]},"api_key":"[REDACTED]","n":'
      || CAST(length(message) AS VARCHAR) || '}' END AS context FROM le""",
)
def _clean(le):
    text = F.concat(
        F.lit(
            '{"__x":1,"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}},"exception":{"_type":"exception",'
            '"class":"E","trace":[{"file":"x","line":1,"args":["s"]}]},"api_key":["s"],"n":'
        ),
        F.length("message").cast("string"),
        F.lit("}"),
    )
    given = F.when(F.col("level") == "debug", F.col("context")).otherwise(text)
    return le.select("id", given.alias("context")).select(
        "id", ctx.clean_context(F.col("context")).alias("context")
    )


# --- requests and capture -------------------------------------------------------


ATTACHED = r""", r AS (SELECT trace_id, arg_min_null(ip_address, id) AS ip_address, arg_min_null(http_method, id) AS http_method, arg_min_null(url, id) AS url
       FROM le WHERE trace_id IS NOT NULL AND level <> 'notice' GROUP BY trace_id)
    SELECT le.id, le.trace_id, r.ip_address, r.http_method, regexp_replace(r.url, 'api_token=[^&#]*', 'api_token=%5BREDACTED%5D') AS url
    FROM le LEFT JOIN r ON le.trace_id = r.trace_id"""


@query("attach_request", ATTACHED)
def _attach(spark, sf_dir):
    le = entries(spark, sf_dir)
    rows = attach_request(le, _requests(le))
    return rows.select("id", "trace_id", "ip_address", "http_method", "url")


def _requests(le):
    return (
        le.where("trace_id IS NOT NULL AND level <> 'notice'")
        .groupBy("trace_id")
        .agg(
            F.min_by("ip_address", "id").alias("ip_address"),
            F.min_by("http_method", "id").alias("http_method"),
            F.min_by("url", "id").alias("url"),
        )
    )


@query("attach_request_salted", ATTACHED)
def _attach_salted(spark, sf_dir):
    le = entries(spark, sf_dir)
    rows = attach_request(le, _requests(le), salts=4)
    return rows.select("id", "trace_id", "ip_address", "http_method", "url")


@query(
    "clean_context_handler",
    """SELECT id, CASE WHEN context IS NULL THEN '{"a":{"b":[{"token":"[REDACTED]"}]},"t":"' || repeat('y', 10000) || '... [truncated]"}' ELSE context END AS context FROM le""",
)
def _clean_handler(spark, sf_dir):
    long = F.concat(
        F.lit('{"_internal_a":1,"a":{"_internal_b":2,"b":[{"token":7}]},"t":"'),
        F.repeat(F.lit("y"), 10_500),
        F.lit('"}'),
    )
    given = F.coalesce("context", long).alias("context")
    rows = entries(spark, sf_dir).select("id", given)
    return rows.select("id", ctx.clean_context(F.col("context"), handler=True).alias("context"))


@query(
    "dedupe_capture",
    "SELECT id, level FROM le",
)
def _dedupe(spark, sf_dir):
    le = entries(spark, sf_dir)
    twice = le.unionByName(le.where("level IN ('error','info')"))
    return dedupe_capture(twice).select("id", "level")


@query(
    "capture",
    r"""SELECT id, level, message, CASE WHEN context IS NULL THEN '{"tenant":1}' ELSE '{"k":' || json_extract_string(context, '$.k') || ',"tenant":1}' END AS context,
    regexp_replace(url, 'api_token=[^&#]*', 'api_token=%5BREDACTED%5D') AS url, source, source_line,
    date_trunc('second', occurred_at) AS occurred_at, status
    FROM le WHERE (channel IS NULL OR channel <> 'deprecations') AND level <> 'notice'""",
)
def _capture(spark, sf_dir):
    le = entries(spark, sf_dir)
    mark = F.when(F.col("level") == "notice", F.lit('{"_internal":true}'))
    raw = le.withColumn("context", F.coalesce(mark, F.col("context")))
    twice = raw.unionByName(raw.where("level = 'error'"))
    rules = CaptureRules(enrich=lambda df: df.withColumn("extra_context", F.lit('{"tenant":1}')))
    return capture(twice, NOW, rules).select(
        "id", "level", "message", "context", "url", "source", "source_line", "occurred_at", "status"
    )
