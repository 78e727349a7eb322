"""Byte-exact previews and cuts, and text matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head_bytes(text: Column, n: int) -> Column:
    """At most the first ``n`` bytes, never ending inside a UTF-8 character.

    A cut position is good when the byte after it does not continue a
    character (0x80-0xBF); a character has at most three such bytes.
    """
    raw = text.cast("binary")

    def continues(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    size = F.lit(max(n - 3, 0))
    for back in (2, 1, 0):
        size = F.when(~continues(n - back + 1), F.lit(max(n - back, 0))).otherwise(size)
    return F.substring(raw, F.lit(1), size).cast("string")


def preview(text: Column, n: int = 500, unit: str = "bytes") -> Column:
    """The text itself when it fits ``n``, otherwise ``n - 3`` units and ``...``."""
    if unit == "chars":
        return F.when(F.length(text) <= n, text).otherwise(
            F.concat(F.substring(text, 1, n - 3), F.lit("..."))
        )
    return F.when(F.octet_length(text) <= n, text).otherwise(
        F.concat(head_bytes(text, n - 3), F.lit("..."))
    )


def cut_chars(text: Column, n: int, marker: str = "… [truncated]") -> Column:
    """The first ``n`` characters, with a marker when something was cut."""
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, n), F.lit(marker))
    )


def contains_text(
    column: Column, value: str, wildcards: bool = True, case_sensitive: bool = False
) -> Column:
    """Null-safe "contains": a null column counts as empty text, never as unknown.

    With ``wildcards`` the value's ``%`` and ``_`` keep their LIKE meaning.
    Backslashes are always plain characters.
    """
    text = F.coalesce(column.cast("string"), F.lit(""))
    if not wildcards:
        if case_sensitive:
            return F.contains(text, F.lit(value))
        return F.contains(F.lower(text), F.lower(F.lit(value)))
    pattern = "%" + value.replace("\\", "\\\\") + "%"
    return text.like(pattern) if case_sensitive else text.ilike(pattern)


def matches_regex(column: Column, pattern: str) -> Column:
    """Null-safe, case-insensitive regular expression search."""
    return F.coalesce(column.cast("string"), F.lit("")).rlike("(?i)" + pattern)
