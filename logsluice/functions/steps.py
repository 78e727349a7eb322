"""Computing expensive values a single time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that no later step computes again.

    Catalyst puts a column's expression wherever the column is used, also into
    filters it moves below; for regular expressions and JSON that multiplies
    the work and the generated code. The rows of a one-element array are as
    many as before, and what a generator gives out is not moved or repeated.
    """
    made = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(
        *[F.col(c) for c in df.columns if c not in values], "_made.*"
    )
