"""Text search: arguments become Columns; every group is two-valued, so that a
negated group is the exact complement of the plain one."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.text import contains_text, matches_regex

# Fields a search may name, and those searched without a name.
FIELDS = (
    "message",
    "source",
    "context",
    "level",
    "channel",
    "user_id",
    "ip_address",
    "url",
    "trace_id",
    "http_method",
)
ANY = "any"
ANY_FIELDS = ("message", "context", "source")

# Forms of a search argument: field:"a b", field:word, "a b", word.
_FORMS = re.compile(
    r"""(?P<minus>-)? (?P<field>\w+) : (?: "(?P<phrase>[^"]+)" | (?P<word>\S+) )
      | "(?P<quoted>[^"]+)"
      | (?P<bare>\S+)""",
    re.VERBOSE | re.ASCII,
)
_FIELD_PREFIX = re.compile(r"\b(?:" + "|".join(FIELDS) + r"):\S", re.IGNORECASE | re.ASCII)
_MINUS_WORD = re.compile(r"(?:^|\s)-\S", re.ASCII)


class Term(NamedTuple):
    field: str
    value: str
    exclude: bool = False


def terms_of(argument: str) -> list[Term]:
    """The terms a search argument stands for."""
    terms = []
    for form in _FORMS.finditer(argument):
        if form["field"]:
            field = form["field"].lower()
            if field in FIELDS:
                terms.append(Term(field, form["phrase"] or form["word"], bool(form["minus"])))
            else:
                terms.append(Term(ANY, form[0]))
        elif form["quoted"]:
            terms.append(Term(ANY, form["quoted"]))
        elif form["bare"].startswith("-") and form["bare"] != "-":
            terms.append(Term(ANY, form["bare"][1:], True))
        else:
            terms.append(Term(ANY, form["bare"]))
    return terms


def is_structured(value: str) -> bool:
    """Whether a value uses search syntax: a quote, ``-word`` or a known ``field:``."""
    return '"' in value or bool(_MINUS_WORD.search(value) or _FIELD_PREFIX.search(value))


def _any_field(test) -> Column:
    return reduce(or_, [test(F.col(c)) for c in ANY_FIELDS])


def contains_term(
    field: str,
    value: str,
    exclude: bool = False,
    wildcards: bool = True,
    case_sensitive: bool = False,
) -> Column:
    """Substring test of one field, or of message, context and source together."""

    def test(column: Column) -> Column:
        return contains_text(column, value, wildcards, case_sensitive)

    hit = test(F.col(field)) if field in FIELDS else _any_field(test)
    return ~hit if exclude else hit


def regex_term(field: str, value: str, exclude: bool = False) -> Column:
    """Regular expression test, case-insensitive."""

    def test(column: Column) -> Column:
        return matches_regex(column, value)

    hit = test(F.col(field)) if field in FIELDS else _any_field(test)
    return ~hit if exclude else hit


def group(terms: Iterable[Term], negate: bool = False, regex: bool = False, **options) -> Column:
    """All terms together; ``negate`` turns the whole group, not its terms."""
    tests = [
        regex_term(*term) if regex else contains_term(*term, **options) for term in terms
    ]
    if not tests:
        return F.lit(True)
    together = reduce(and_, tests)
    return ~together if negate else together


def search(
    entries: Iterable[dict], regex: bool = False, search_syntax: bool = True, **options
) -> Column:
    """Several ``{field, value, exclude}`` entries, each its own group, ANDed.

    Entries without a value count as absent; unknown fields mean any field.
    """
    groups = []
    for entry in entries:
        value = entry.get("value")
        if value is None or value == "":
            continue
        value = str(value)
        field = entry.get("field") or ANY
        if field not in FIELDS:
            field = ANY
        if field == ANY and search_syntax and is_structured(value):
            terms = terms_of(value)
        else:
            terms = [Term(field, value)]
        negate = entry.get("exclude") not in (None, False, 0, "", "0")
        groups.append(group(terms, negate, regex, **options))
    return reduce(and_, groups) if groups else F.lit(True)


def search_text(argument: str, regex: bool = False, negate: bool = False, **options) -> Column:
    """One argument, always read with the search syntax."""
    return group(terms_of(argument), negate, regex, **options)


def simple_search(value: str) -> Column:
    """Without the syntax: the message or its preview contains the value."""
    if not value:
        return F.lit(True)
    return contains_text(F.col("message"), value) | contains_text(F.col("message_preview"), value)


def complement_check(df: DataFrame, condition: Column) -> DataFrame:
    """One pass: rows in, rows out, all rows, and whether the first two add up."""
    return df.agg(
        F.count_if(condition).alias("included"),
        F.count_if(~condition).alias("excluded"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("ok", F.col("included") + F.col("excluded") == F.col("total"))
