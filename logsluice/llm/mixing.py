"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import numbered, pick, shuffle_tasks, stored

PERIOD = 1024
BLOCK_ROWS = 16


def quotas(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Blocks of each source in one period: whole numbers, at least 1, ``period`` in all.

    The period is taken four times as long as there are sources, if that is more.
    """
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (given[s] - exact[s], s))
    while (missing := period - sum(given.values())) > 0:
        for s in by_rest[:missing]:
            given[s] += 1
    while (over := sum(given.values()) - period) > 0:
        largest = max((s for s in given if given[s] > 1), key=lambda s: (given[s] - exact[s], given[s], s))
        given[largest] -= min(over, 1)
    return given


def schedule(quota: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period: (source, block, release, deadline, slot) for each slot.

    Block j of a source with p of q blocks may go no earlier than floor(j q / p) and
    must go before ceil((j + 1) q / p). In each slot the released block with the
    earliest deadline goes (then by source). Blocks have unit length and the
    windows follow the fluid schedule, so every deadline is met: at any slot a source
    is less than one block away from its share. All windows end with the period, so
    periods follow each other unchanged.
    """
    period = sum(quota.values())

    def window(s: str, j: int) -> tuple[int, int]:
        p = quota[s]
        return j * period // p, -(-(j + 1) * period // p)

    coming = [(0, s, 0) for s in quota]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    slots = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            release, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (window(s, j)[1], s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        slots.append((s, j, release, deadline, slot))
        if j + 1 < quota[s]:
            heapq.heappush(coming, (window(s, j + 1)[0], s, j + 1))
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD):
    """Runs of whole periods with one set of sources: (first slot, sources' first blocks, quotas, end blocks).

    A source that has run out leaves; its weight goes to the others in proportion
    with the next period. So there are at most as many phases as sources.
    """
    left, slot, made = {s: n for s, n in blocks.items() if n}, 0, []
    used = dict.fromkeys(blocks, 0)
    while left:
        quota = quotas({s: weights[s] for s in left}, period)
        rounds = min(-(-n // quota[s]) for s, n in left.items())
        taken = {s: min(n, rounds * quota[s]) for s, n in left.items()}
        made.append((slot, {s: used[s] for s in left}, quota, {s: used[s] + taken[s] for s in left}))
        for s, n in taken.items():
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += rounds * sum(quota.values())
    return made


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _scheduled(rows: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, block: int) -> DataFrame:
    """``rows`` has __source, __order and anything else; adds the block's place in the schedule."""
    spark = rows.sparkSession
    # One number for each source: their count is bounded by the configuration.
    sizes = {r[0]: r[1] for r in rows.groupBy("__source").count().collect()}
    if weights is None:
        share = {s: float(n) ** alpha for s, n in sizes.items()}
    else:
        share = {("n" if s is None else f"s{s}"): float(w) for s, w in weights.items()}
        unknown = sorted(s for s in sizes if share.get(s, 0.0) <= 0)
        if unknown:
            raise ValueError(f"no weight above 0 for the sources {unknown}")
    plan = phases({s: -(-n // block) for s, n in sizes.items()}, {s: share[s] for s in sizes})
    spans, pattern = [], []
    for number, (slot, first, quota, end) in enumerate(plan):
        period = sum(quota.values())
        spans += [(s, number, first[s], end[s], quota[s], period, slot) for s in first]
        pattern += [(s, number, *place) for s, *place in schedule(quota)]
    spans = spark.createDataFrame(
        spans, "s string, phase int, first long, end long, quota long, period long, slot0 long"
    )
    pattern = spark.createDataFrame(pattern, "s2 string, phase2 int, j long, rel long, dead long, at long")
    turn = (F.col("block") - F.col("first")) / F.col("quota")
    start = F.col("slot0") + F.floor(turn) * F.col("period")
    # Both tables were made on the driver. Without the hint their size is unknown to Spark, which then deals
    # the rows anew for each join, with all they carry.
    return (
        numbered(rows, ["__source"], ["__order"], "__row")
        .withColumn("block", F.floor(F.col("__row") / block))
        .join(F.broadcast(spans), (F.col("__source") == F.col("s")) & F.col("block").between(F.col("first"), F.col("end") - 1))
        .withColumn("__j", (F.col("block") - F.col("first")) % F.col("quota"))
        .join(
            F.broadcast(pattern),
            (F.col("__source") == F.col("s2")) & (F.col("phase") == F.col("phase2")) & (F.col("__j") == F.col("j")),
        )
        .withColumn("release", (start + F.col("rel")).cast("long"))
        .withColumn("deadline", (start + F.col("dead")).cast("long"))
        .withColumn("slot", (start + F.col("at")).cast("long"))
        .withColumn("position", (F.col("slot") * block + F.col("__row") % block).cast("long"))
        .withColumn("target_weight", F.col("quota") / F.col("period"))
    )


def _keys(docs: DataFrame) -> list[Column]:
    return [
        _source_key(F.col("source").cast("string")).alias("__source"),
        # A hash first: documents of a source come in an order of their own.
        F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id").cast("long").alias("d")).alias("__order"),
    ]


def mix_schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The place of every document in a stream in which the sources keep their weights.

    Needs ``doc_id`` and ``source``; other columns are ignored. ``weights`` has a
    target for each source (None: the null source); without it the targets are the
    sources' numbers of rows to the power ``alpha``. Returns doc_id, source, phase,
    target_weight, block, release, deadline, slot and position; rows ordered by
    position are the mixed stream.

    Documents of a source are cut into blocks of ``block_rows`` in hash order. Blocks
    get release times and deadlines from the target, and earliest deadline first
    gives each its slot; as long as the same sources last (a phase), each is less
    than one block away from its share at any slot. The schedule repeats after a
    period, so only one period for each phase is made on the driver, and a block's
    slot follows from its number. No row is repeated or left out: when a source has
    run out, its slots in that period stay empty and the others share its weight
    from the next one. Targets are rounded to 1 / period.

    The null source is a source. A null doc_id is ordered like any key; repeated rows
    get different positions. Texts are not read. An empty table gives no rows.
    """
    base = pick(docs, doc_id="long", source="string")
    rows = stored(base.select("*", *_keys(base)), "to-mix")
    columns = ["doc_id", "source", "phase", "target_weight", "block", "release", "deadline", "slot", "position"]
    return _scheduled(rows, weights, alpha, block_rows).select(*columns)


def mix_rows(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with all its columns, in the order of ``mix_schedule``.

    Partitions follow each other in that order and are sorted inside, so every
    stretch of the files written from it has the target mix. Whole rows are dealt twice: to be
    numbered, and to their place.
    """
    rows = docs.select(F.struct("*").alias("__kept"), *_keys(docs))
    placed = _scheduled(rows, weights, alpha, block_rows).select("__kept", "position")
    last = placed.agg(F.max("position")).first()[0]
    if last is None:
        return docs
    tasks = shuffle_tasks(docs.sparkSession)
    part = F.least(F.floor(F.col("position") * tasks / F.lit(last + 1)), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, part).sortWithinPartitions("position").select("__kept.*")
