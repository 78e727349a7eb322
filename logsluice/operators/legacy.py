"""Tables of older installs, which had resolved_at/resolved_by instead of a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upgrade_legacy(df: DataFrame) -> DataFrame:
    """Resolved rows get the status; frames that are new already stay as they are."""
    if "resolved_at" not in df.columns:
        return df
    time = df.schema["resolved_at"].dataType
    have = set(df.columns)
    resolved = F.col("resolved_at").isNotNull()
    old = {
        "status": F.col("status") if "status" in have else F.lit("open"),
        "status_changed_at": F.col("status_changed_at")
        if "status_changed_at" in have
        else F.lit(None).cast(time),
        "status_changed_by": F.col("status_changed_by")
        if "status_changed_by" in have
        else F.lit(None).cast("string"),
    }
    new = {
        "status": F.lit("resolved"),
        "status_changed_at": F.col("resolved_at"),
        "status_changed_by": F.col("resolved_by")
        if "resolved_by" in have
        else F.lit(None).cast("string"),
    }
    return df.withColumns(
        {c: F.when(resolved, new[c]).otherwise(old[c]) for c in new}
    ).drop("resolved_at", "resolved_by", "environment")


def downgrade_legacy(df: DataFrame) -> DataFrame:
    """The way back: only the status ``resolved`` survives, the environment is unknown."""
    if "status" not in df.columns:
        return df
    resolved = F.col("status") == "resolved"
    return df.withColumns(
        {
            "environment": F.lit(None).cast("string"),
            "resolved_at": F.when(resolved, F.col("status_changed_at")),
            "resolved_by": F.when(resolved, F.col("status_changed_by")),
        }
    ).drop("status", "status_changed_at", "status_changed_by")
