"""The capture plan: what happens to a record between the logger and the table.
The same code runs on a batch frame and inside a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.functions.context import clean_context, merge_context, source_from_exception
from logsluice.functions.url import SENSITIVE_KEYS, redact_url
from logsluice.operators.filters import drop_deprecations, drop_internal, drop_null_channel
from logsluice.operators.prepare import prepare_entries
from logsluice.schema import Limits


@dataclass(frozen=True)
class CaptureRules:
    """What is left out and how the rest is shaped."""

    ignore_deprecations: bool = True
    deprecation_channels: Sequence[str] = ("deprecations",)
    ignore_null_channel: bool = False
    redact: bool = True
    sensitive_keys: Sequence[str] = SENSITIVE_KEYS
    key_cols: Sequence[str] = ()
    limits: Limits = field(default_factory=Limits)
    # Adds `extra_context` (JSON text) and, where that failed, `extra_error`.
    enrich: Callable[[DataFrame], DataFrame] | None = None


def dedupe_capture(df: DataFrame, key: str = "id") -> DataFrame:
    """A record that arrives by two ways is kept once.

    On a stream all keys are remembered, so no row is too late and a copy is told however
    late it comes; a stream into a stored table needs no such memory, as
    :func:`unseen` asks the table. Rows without a key are all kept; on a stream they pass
    beside the state. A frame without the column stays as it is.
    """
    if key not in df.columns:
        return df
    if df.isStreaming:
        keyed = df.where(F.col(key).isNotNull()).dropDuplicates([key])
        return keyed.unionByName(df.where(F.col(key).isNull()))
    # Rows without a key are told apart by their place, in the same pass.
    place = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_place", place).dropDuplicates([key, "_place"]).drop("_place")


def unseen(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not among those stored; rows without a key all stay.

    ``stored`` is narrowed to the rows' keys first: for a small batch that is a broadcast
    of its keys, and nothing of the stored keys is shuffled.
    """
    asked = rows.select(key).where(F.col(key).isNotNull()).distinct()
    copies = stored.select(key).join(asked, key, "left_semi").distinct()
    return rows.join(copies, key, "left_anti")


def ignore(df: DataFrame, rules: CaptureRules) -> DataFrame:
    df = drop_deprecations(df, rules.deprecation_channels, rules.ignore_deprecations)
    return drop_null_channel(df, rules.ignore_null_channel)


def build(df: DataFrame, rules: CaptureRules) -> DataFrame:
    """Context merged and cleaned, URL redacted, source taken from the exception."""
    rows = rules.enrich(df) if rules.enrich else df
    context = F.col("context")
    if "extra_context" in rows.columns:
        error = F.col("extra_error") if "extra_error" in rows.columns else None
        context = merge_context(context, F.col("extra_context"), error)
    found = source_from_exception(F.col("context"))
    kept = {
        name: F.coalesce(F.col(name), found[name]) if name in rows.columns else found[name]
        for name in ("source", "source_line")
    }
    rows = rows.withColumns(
        {**kept, "context": clean_context(context, rules.sensitive_keys, redact=rules.redact)}
    )
    if "url" in rows.columns:
        rows = rows.withColumn("url", redact_url(F.col("url"), rules.sensitive_keys, rules.redact))
    return rows.drop("extra_context", "extra_error")


def capture(
    df: DataFrame,
    now: datetime,
    rules: CaptureRules = CaptureRules(),
    dedupe_key: str | None = "id",
) -> DataFrame:
    """Internal and ignored records out, duplicates out, then shaped for storage.

    What depends on the row alone goes first: copies share it, and what is left out
    is not shuffled.
    """
    rows = ignore(drop_internal(df), rules)
    if dedupe_key:
        rows = dedupe_capture(rows, dedupe_key)
    rows = build(rows, rules)
    return prepare_entries(rows, now, rules.limits, key_cols=rules.key_cols or None)
