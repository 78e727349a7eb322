"""Request details carried by every entry of that request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.functions.url import SENSITIVE_KEYS, redact_url

REQUEST_COLUMNS = ("ip_address", "user_agent", "http_method", "url")
# Entries outside any request are dealt out over this many join keys.
NULL_SPREAD = 1024


def attach_request(
    logs: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = SENSITIVE_KEYS,
    id_col: str = "id",
    salts: int = 1,
) -> DataFrame:
    """Left join on ``trace_id``; a request's URL is redacted.

    A trace given more than once counts once: the first of its rows in the order of
    ``REQUEST_COLUMNS``, nulls last.

    Both sides may be large, so neither is forced to broadcast. Entries without
    a trace match nothing; they get spread-out keys instead of meeting in one
    task. A request with very many entries is left to AQE, which splits the
    skewed left side of this join; with ``salts`` every request is joined by
    that many tasks, at the price of as many copies of the request rows.
    """
    own = [c for c in logs.columns if c not in REQUEST_COLUMNS]
    present = [c for c in REQUEST_COLUMNS if c in requests.columns]
    right = requests.where(F.col("trace_id").isNotNull()).select(
        F.col("trace_id").alias("_key"),
        *[
            (redact_url(F.col(c), keys) if c == "url" else F.col(c)).alias(c)
            for c in present
        ],
    )
    if present:
        # The least of whole rows combines before the shuffle.
        ranked = F.struct(*(x for c in present for x in (F.col(c).isNull().alias(f"{c}_missing"), F.col(c))))
        right = right.groupBy("_key").agg(F.min(ranked).alias("row")).select("_key", *(f"row.{c}" for c in present))
    else:
        right = right.distinct()
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(id_col), F.lit(NULL_SPREAD)).cast("string"))
    left = logs.select(*own).withColumn("_key", F.coalesce(F.col("trace_id"), spread))
    if salts <= 1:
        return left.join(right, "_key", "left").drop("_key")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["_key", "_salt"], "left").drop("_key", "_salt")
