"""What a micro-batch is called in the tables it is written to."""

from __future__ import annotations

import json

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.ids import ulid
from logsluice.schema import epoch_micros
from logsluice.session import path_exists


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps for as long as its checkpoint lives.

    Batch numbers start again with a new checkpoint; only together with this
    id do they name a micro-batch that nothing else may overwrite.
    """
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def batch_moment(spark: SparkSession, checkpoint: str, batch: int) -> datetime:
    """When a micro-batch was first stored: written down once, then read back."""
    path = f"{checkpoint}-moments/{batch}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        told = datetime.now().astimezone().isoformat()
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return datetime.fromisoformat(spark.read.text(path).first()[0])


def with_batch_ids(rows: DataFrame, tag: str) -> DataFrame:
    """Ids for rows that have none, from the batch, the row's place in it and its content.

    Rows without an id are never shuffled before, so their places are those of the source.
    """
    own = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    at = F.lit(0)
    if "occurred_at" in rows.columns:
        at = F.coalesce(F.floor(epoch_micros(F.col("occurred_at"), rows.schema["occurred_at"].dataType) / 1000), at)
    content = F.to_json(F.struct(*(c for c in rows.columns if c != "id")))
    made = ulid(at, [F.lit(tag), F.monotonically_increasing_id(), content])
    return rows.withColumn("id", F.coalesce(own, made))
