"""Redaction of sensitive query parameters in URLs, all in built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key parts and header names that must not be stored in clear.
SENSITIVE_KEYS = (
    "password",
    "password_confirmation",
    "secret",
    "token",
    "api_key",
    "apikey",
    "authorization",
    "credit_card",
    "card_number",
    "cvv",
    "ssn",
)
SENSITIVE_HEADERS = ("authorization", "cookie", "x-csrf-token", "x-xsrf-token")
REDACTED = "[REDACTED]"


def _any_of(keys: Sequence[str]) -> str:
    return "|".join(re.escape(key) for key in keys)


def has_sensitive_part(name: Column, keys: Sequence[str]) -> Column:
    """Case-insensitive substring match of a key name against the list."""
    if not keys:
        return F.lit(False)
    return name.rlike("(?i)" + _any_of(keys))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    # Java leaves '*' alone; form encoding as wanted here does not.
    return F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))


def _after_first(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, mark) + 1, F.length(text))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.transform(F.array(value), use)[0]


def _split_pair(pair: Column) -> Column:
    value = F.when(F.contains(pair, F.lit("=")), _after_first(pair, "=")).otherwise("")
    return F.struct(
        _decoded(F.substring_index(pair, "=", 1)).alias("name"), _decoded(value).alias("value")
    )


def _plain_name(pair: Column) -> Column:
    """Blanks and dots in front of a bracket become underscores."""
    base = F.translate(F.substring_index(pair["name"], "[", 1), " .", "__")
    brackets = F.substring(pair["name"], F.length(base) + 1, F.length(pair["name"]))
    return F.struct(base.alias("base"), brackets.alias("brackets"), pair["value"].alias("value"))


def _redacted(pair: Column, keys: Sequence[str]) -> Column:
    # A sensitive outer name hides its whole subtree, so the brackets go too.
    outer = has_sensitive_part(pair["base"], keys)
    inner = has_sensitive_part(pair["brackets"], keys)
    return F.struct(
        F.when(outer, pair["base"]).otherwise(F.concat(pair["base"], pair["brackets"])).alias("key"),
        F.when(outer | inner, F.lit(REDACTED)).otherwise(pair["value"]).alias("value"),
    )


def _last_of_each(params: Column) -> Column:
    """A key's last value at the key's first place; ``name[]`` entries all stay."""
    names = F.array_distinct(F.transform(params, lambda p: p["key"]))

    def entries_of(name: Column) -> Column:
        own = F.filter(params, lambda p: p["key"] == name)
        return F.when(F.endswith(name, F.lit("[]")), own).otherwise(F.slice(own, -1, 1))

    return F.when(F.size(names) == F.size(params), params).otherwise(
        F.flatten(F.transform(names, entries_of))
    )


def _rebuilt_query(query: Column, keys: Sequence[str]) -> Column:
    pairs = F.filter(
        F.split(query, "&"), lambda p: (F.length(p) > 0) & ~F.startswith(p, F.lit("="))
    )
    named = F.transform(F.transform(pairs, _split_pair), _plain_name)
    params = F.transform(named, lambda p: _redacted(p, keys))
    return F.array_join(
        F.transform(
            _once(params, _last_of_each),
            lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"])),
        ),
        "&",
    )


def redact_url(url: Column, keys: Sequence[str] = SENSITIVE_KEYS, enabled: bool = True) -> Column:
    """Replace the values of sensitive query parameters.

    Only URLs with scheme, host and query are touched; these are rebuilt from
    their parts, which drops user-info and re-encodes every value. A name that
    comes twice keeps its first place and its last value; ``name[]`` entries
    are kept one by one.
    """
    if not enabled:
        return url
    before_fragment = F.substring_index(url, "#", 1)
    fragment = F.substring(url, F.length(before_fragment) + 1, F.length(url))
    base = F.substring_index(before_fragment, "?", 1)
    query = F.substring(before_fragment, F.length(base) + 2, F.length(before_fragment))
    rebuilt = _once(
        _rebuilt_query(query, keys),
        lambda q: F.when(F.length(q) > 0, F.concat(F.lit("?"), q)).otherwise(""),
    )
    site = F.regexp_replace(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@", "$1")
    applies = before_fragment.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?][^?]*\?")
    # Most queries are plain: no character that is written differently, no name
    # twice. There a value can be replaced in place, which is far cheaper than
    # taking the query apart.
    plain = before_fragment.rlike(
        r"^[^@?]*\?[A-Za-z0-9_\-]+=[\w.\-]*(?:&[A-Za-z0-9_\-]+=[\w.\-]*)*$"
    ) & ~before_fragment.rlike(r"[?&]([^=&]+)=.*&\1=")
    in_place = before_fragment
    if keys:
        sensitive = rf"(?i)([?&][^=&]*(?:{_any_of(keys)})[^=&]*=)[^&]*"
        in_place = F.regexp_replace(before_fragment, sensitive, "$1" + quote(REDACTED))
    return (
        F.when(applies & plain, F.concat(in_place, fragment))
        .when(applies, F.concat(site, rebuilt, fragment))
        .otherwise(url)
    )


def redact_headers(headers: Column, names: Sequence[str] = SENSITIVE_HEADERS) -> Column:
    """Header map with the listed names' values replaced (exact, any case)."""
    return F.transform_values(
        headers,
        lambda name, values: F.when(
            F.lower(name).isin(*names), F.array(F.lit(REDACTED))
        ).otherwise(values),
    )
