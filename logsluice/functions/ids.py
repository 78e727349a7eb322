"""Deterministic, time-ordered row ids."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base-32 digits as conv() writes them, and the ULID alphabet's
# letters at the same places (no i, l, o, u).
_CONV_DIGITS = "ijklmnopqrstuv"
_ULID_DIGITS = "jkmnpqrstvwxyz"
# The form of a ULID, whose first ten digits are milliseconds.
_ULID = re.compile(r"[0-7][0-9a-hjkmnp-tv-z]{25}", re.IGNORECASE)
_DIGITS = "0123456789abcdefghjkmnpqrstvwxyz"


def ulid_time(entry_id: str) -> datetime | None:
    """The moment that a ULID tells; ``None`` for other ids and for moments no calendar has."""
    if not _ULID.fullmatch(entry_id):
        return None
    millis = 0
    for digit in entry_id[:10].lower():
        millis = millis * 32 + _DIGITS.index(digit)
    try:
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=millis)
    except OverflowError:
        return None


def _base32(number: Column, base: int, width: int) -> Column:
    digits = F.lpad(F.lower(F.conv(number.cast("string"), base, 32)), width, "0")
    return F.translate(digits, _CONV_DIGITS, _ULID_DIGITS)


def ulid(millis: Column, keys: Sequence[Column]) -> Column:
    """26 lower-case characters: 48 bits of time, 80 bits hashed from ``keys``.

    With keys that tell rows apart, a retried task or a replayed micro-batch
    gives every row the id it had before. Without keys the tail is random, so
    that equal records still get ids of their own.
    """
    if keys:
        parts = [F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys]
        digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    else:
        digest = F.sha2(F.expr("uuid()"), 256)
    return F.concat(
        _base32(millis, 10, 10),
        _base32(F.substring(digest, 1, 10), 16, 8),
        _base32(F.substring(digest, 11, 10), 16, 8),
    )
