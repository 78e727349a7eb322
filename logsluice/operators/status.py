"""The status vocabulary: four built-ins, changed or extended by overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.schema import BUILT_IN_STATUSES

Row = tuple[str, str, str, bool]


def status_rows(overrides: dict | None = None) -> list[Row]:
    """``(value, label, color, closed)`` of every status, custom ones last."""
    overrides = overrides or {}
    built_in = {s[0] for s in BUILT_IN_STATUSES}
    defaults = list(BUILT_IN_STATUSES) + [
        (name, name[:1].upper() + name[1:], "gray", False)
        for name in overrides
        if name not in built_in
    ]
    rows = []
    for name, label, color, is_closed in defaults:
        given = {k: v for k, v in (overrides.get(name) or {}).items() if v is not None}
        rows.append(
            (name, given.get("label", label), given.get("color", color), given.get("closed", is_closed))
        )
    return rows


def status_dimension(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    return spark.createDataFrame(
        status_rows(overrides), "value string, label string, color string, closed boolean"
    )


def check_status(value: str, overrides: dict | None = None) -> str:
    if value not in {s[0] for s in status_rows(overrides)}:
        raise ValueError(f"invalid status: {value!r}")
    return value


def valid_changes(changes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Changes whose status the dimension knows."""
    return changes.join(dimension.select(F.col("value").alias("status")), "status", "left_semi")
