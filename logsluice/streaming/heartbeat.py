"""The failure heartbeat over an unbounded input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsluice.operators.failures import EVERY, FAILURE_KEY, keep_beat, occurrences
from logsluice.session import drop_path
from logsluice.streaming.identity import stream_id

# So many runs of counters of one level are merged into one of the next.
FAN = 8

Run = tuple[int, int]


def live_runs(batch: int) -> list[Run]:
    """The runs, as (level, first batch), that hold the counts of all batches before ``batch``.

    A run of level n is that of ``FAN ** n`` batches; the digits of the number tell how many
    there are of each level.
    """
    runs, first = [], 0
    level = 0
    while FAN ** (level + 1) <= batch:
        level += 1
    for level in range(level, -1, -1):
        while first + FAN**level <= batch:
            runs.append((level, first))
            first += FAN**level
    return runs


def merged_at(batch: int) -> list[Run]:
    """The runs that are merged once ``batch`` has written its own, ``FAN`` of each level, lowest level first."""
    merged = []
    level = 0
    while batch >= 0 and (batch + 1) % FAN ** (level + 1) == 0:
        start = batch + 1 - FAN ** (level + 1)
        merged += [(level, start + i * FAN**level) for i in range(FAN)]
        level += 1
    return merged


def _run_path(counters: str, level: int, first: int) -> str:
    return f"{counters}/level={level}/first={first}"


def _counters(spark: SparkSession, counters: str, runs: Sequence[Run], schema: T.StructType) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(_run_path(counters, *run) for run in runs))


def heartbeat_stream(
    failures: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    key: Sequence[str] = FAILURE_KEY,
    order: Sequence[str] = ("at",),
    every: int = EVERY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the first and every ``every``-th failure of each key to ``out``.

    The state is runs of counters, one per key. A micro-batch writes a run of its own keys
    alone; ``FAN`` runs of one level are merged into one of the next, so a counter is written
    once per level and what a batch writes follows the keys it holds. Which runs there are
    follows from the batch's number, and no run is removed before the batch that merged it
    is committed: a replayed micro-batch reads the runs it read before and overwrites its own.
    Of the counters before, only those of the batch's keys go into the numbering, which is
    the batch operator; so a key with very many rows is spread over tasks, which a state
    function called once per key could not do. A new checkpoint is a new stream: it counts
    from the start and writes beside.
    """
    schema = failures.select(*key).schema.add("n", T.LongType())

    def beat(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        stream = stream_id(spark, checkpoint)
        counters = f"{state}/stream={stream}"
        rows.persist()
        try:
            for level, first in merged_at(batch - 1):
                drop_path(spark, _run_path(counters, level, first))
            here = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            before = _counters(spark, counters, live_runs(batch), schema)
            same_key = reduce(and_, (F.col(f"known.{c}").eqNullSafe(F.col(f"here.{c}")) for c in key))
            known = before.alias("known").join(here.alias("here"), same_key, "left_semi")
            numbered = occurrences(rows, key, order, before=known)
            numbered.where(keep_beat(F.col("occurrence"), every)).write.mode(
                "overwrite"
            ).parquet(f"{out}/stream={stream}/batch={batch}")
            here.write.mode("overwrite").parquet(_run_path(counters, 0, batch))
            merges = merged_at(batch)
            for level, first in merges[::FAN]:
                runs = [run for run in merges if run[0] == level]
                total = _counters(spark, counters, runs, schema).groupBy(*key).agg(F.sum("n").alias("n"))
                total.write.mode("overwrite").parquet(_run_path(counters, level + 1, first))
        finally:
            rows.unpersist()

    return (
        failures.writeStream.foreachBatch(beat)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
