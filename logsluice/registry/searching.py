"""Text search over the entries and over longer texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.operators import search as s
from logsluice.registry.base import entries_query, query, table

_ANY = "(coalesce(message,'') ILIKE '%{0}%' OR coalesce(context,'') ILIKE '%{0}%' OR coalesce(source,'') ILIKE '%{0}%')"


def _search(name: str, condition, where: str) -> None:
    entries_query(name, f"SELECT id, message FROM le WHERE {where}")(
        lambda le: le.where(condition()).select("id", "message")
    )


_search("search_any", lambda: s.search([{"value": "user 12"}]), _ANY.format("user 12"))
_search(
    "search_any_excluded",
    lambda: s.search([{"value": "user 12", "exclude": True}]),
    "NOT " + _ANY.format("user 12"),
)
_search(
    "search_structured",
    lambda: s.search([{"value": "level:error -message:\"user 1\" failed"}]),
    "level ILIKE '%error%' AND message NOT ILIKE '%user 1%' AND " + _ANY.format("failed"),
)
_search(
    "search_structured_excluded",
    lambda: s.search([{"value": "channel:stack -click", "exclude": "1"}, {"field": "nowhere", "value": "7"}]),
    "NOT (coalesce(channel,'') ILIKE '%stack%' AND NOT " + _ANY.format("click") + ") AND " + _ANY.format("7"),
)
_search(
    "search_plain_colon",
    lambda: s.search([{"value": "failed: user 3"}]),
    _ANY.format("failed: user 3"),
)
_search(
    "search_text",
    lambda: s.search_text('"failed: user" user_id:1 -source:S3 error'),
    _ANY.format("failed: user")
    + " AND coalesce(CAST(user_id AS VARCHAR),'') ILIKE '%1%' AND coalesce(source,'') NOT ILIKE '%S3%' AND "
    + _ANY.format("error"),
)
_search(
    "search_unknown_field",
    lambda: s.search_text("nofield:x event", negate=True),
    "NOT (" + _ANY.format("nofield:x") + " AND " + _ANY.format("event") + ")",
)
_search(
    "search_text_page",
    lambda: s.search_text("url:page=3 http_method:p -ip_address:10.1"),
    "coalesce(url,'') ILIKE '%page=3%' AND coalesce(http_method,'') ILIKE '%p%' "
    "AND coalesce(ip_address,'') NOT ILIKE '%10.1%'",
)
_search(
    "search_wildcards",
    lambda: s.group([s.Term("message", "user _2 event")]),
    "message ILIKE '%user _2 event%'",
)
_search(
    "search_literal",
    lambda: s.group([s.Term("url", "PAGE=1&api_")], wildcards=False),
    "contains(lower(coalesce(url,'')), 'page=1&api_')",
)
_search(
    "search_backslash",
    lambda: s.contains_term("message", "App\\Jobs", exclude=True),
    "NOT contains(lower(message), 'app\\jobs')",
)
_search(
    "search_regex",
    lambda: s.search([{"field": "message", "value": "^ERROR.*event \\d*7$"}], regex=True),
    "regexp_matches(message, '(?i)^ERROR.*event \\d*7$')",
)
_search(
    "search_regex_any_excluded",
    lambda: s.search([{"value": "services/s[0-3]", "exclude": True}], regex=True),
    "NOT (regexp_matches(message,'(?i)services/s[0-3]') OR regexp_matches(coalesce(context,''),'(?i)services/s[0-3]') "
    "OR regexp_matches(coalesce(source,''),'(?i)services/s[0-3]'))",
)


@entries_query(
    "search_simple",
    "SELECT id, message FROM le WHERE message ILIKE '%signup%' OR left(message, 12) ILIKE '%signup%'",
)
def _simple(le):
    with_preview = le.withColumn("message_preview", F.substring("message", 1, 12))
    return with_preview.where(s.simple_search("signup")).select("id", "message")


@entries_query(
    "complement_check",
    f"""SELECT count(*) FILTER (WHERE c) AS included, count(*) FILTER (WHERE NOT c) AS excluded, count(*) AS total,
       count(*) FILTER (WHERE c) + count(*) FILTER (WHERE NOT c) = count(*) AS ok
    FROM (SELECT (coalesce(source,'') ILIKE '%S1%' AND NOT (coalesce(channel,'') ILIKE '%daily%')) AS c FROM le)""",
)
def _complement(le):
    return s.complement_check(le, s.search_text("source:S1 -channel:daily"))


@query(
    "search_documents",
    "SELECT doc_id, lang FROM documents WHERE text ILIKE '%license%' AND NOT (text ILIKE '%http%')",
    raw=True,
)
def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return docs.where(s.search_text("message:license -message:http")).select("doc_id", "lang")


@query(
    "search_conversations_regex",
    "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '(?i)(quean|the)\\w*')",
    raw=True,
)
def _conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("text", "message")
    found = turns.where(s.regex_term("message", r"(quean|the)\w*"))
    return found.select("conv_id", "turn", "role")
