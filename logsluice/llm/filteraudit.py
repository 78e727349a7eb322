"""Filter interaction audit: what filters remove in every order in which they can be applied."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import pick, stored
from logsluice.llm.transducer import MEASURES, measured

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(order) for order in permutations(FILTERS)]


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, part, sha and the measures of each whole text (null: empty), one row per row.

    Very long texts are read piece by piece; beside the text a task holds the spans of
    its different words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, doc_id="long", text="string", lang="string").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.alias("text"),
    )
    kinds = ", ".join(f"{name} long" for name in MEASURES)
    return rows.mapInArrow(measured, f"doc_id long, part string, sha binary, {kinds}")


def own_failures() -> Column:
    """A bit for each of the filters A to D that a text fails by itself."""
    words, distinct, capitals = F.col("n_words"), F.col("n_distinct"), F.col("n_capitals")
    fails = [
        words < 100,
        100 * distinct < 80 * words,
        100 * capitals > 10 * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each filter), good, toxic for every row.

    Filter E asks for the smallest doc_id of each text, found by digest and combined
    before the shuffle. Rows look for themselves among these by digest and id, so a text
    with a third of all rows is no hot key of the join. Rows without an id fail no E and have no label.
    """
    rows = stored(text_measures(docs).select("doc_id", "part", "sha", own_failures().alias("own")), "measures")
    keyed = rows.where("doc_id IS NOT NULL")
    firsts = keyed.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (
        pick(labels, doc_id="long", quality="int", toxic="int")
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    )
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    with_id = (
        keyed.join(firsts, ["doc_id", "sha"], "left")
        .select("doc_id", "part", (F.col("own") + copy).alias("fails"))
        .join(marks, "doc_id", "left")
        .select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    )
    without = rows.where("doc_id IS NULL").select(
        "part", F.col("own").alias("fails"), F.lit(False).alias("good"), F.lit(False).alias("toxic")
    )
    return with_id.unionByName(without)


def steps_json() -> str:
    """Every order and step: its filter's bit and place, and the filters applied before and with it."""
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            place = FILTERS.index(letter)
            after = before | 1 << place
            out.append({"filter_order": order, "step": step, "place": place, "before": before, "after": after})
            before = after
    return json.dumps(out)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (language; null: empty), order of the five filters and step, what the step does.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % capitals; D: a symbol of
    ``#$%&*|``; E: the text of a smaller doc_id. Returns kept (after the step), removed (by it),
    redundant (failing its filter, removed earlier), unique_fails (failing no other), good_lost
    and toxic_lost (removed, of those labelled so), shapley (removed by its filter, over all 120 orders).

    Documents are counted by part and combination of failed filters, at most 32 a part,
    before the orders come in; what passes a set of filters is a sum of such counts.
    Null and empty texts are equal to each other and have no words. Rows with equal id and text do not fail E through
    each other; rows without an id never do. Several labels of one id count together.
    Extra columns are ignored. An empty table gives no rows.
    """
    flags = [F.count_if(c).alias(c) for c in ("good", "toxic")]
    cells = judged(docs, labels).groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), *flags)

    def passing(column: str) -> Column:
        sums = [F.sum(F.when(F.col("fails").bitwiseAND(s) == 0, F.col(column)).otherwise(0)) for s in range(ALL + 1)]
        return F.array(*sums).alias(column)

    # The first of k failed filters is each of them in one k-th of all orders.
    share = F.col("n") * (factorial(len(FILTERS)) / F.bit_count("fails")).cast("long")
    first = [F.sum(F.when(F.col("fails").bitwiseAND(1 << i) != 0, share).otherwise(0)) for i in range(len(FILTERS))]
    parts = cells.groupBy("part").agg(*map(passing, ("n", "good", "toxic")), F.array(*first).alias("shapley"))
    kind = "array<struct<filter_order: string, step: int, place: int, before: int, after: int>>"
    steps = parts.select("*", F.inline(F.from_json(F.lit(steps_json()), kind)))
    lost = {c: F.expr(f"{c}[before] - {c}[after]") for c in ("n", "good", "toxic")}
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr("n[after]").alias("kept"),
        lost["n"].alias("removed"),
        F.expr("n[0] - n[shiftleft(1, place)] - (n[before] - n[after])").alias("redundant"),
        F.expr(f"n[{ALL} - shiftleft(1, place)] - n[{ALL}]").alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.expr("shapley[place]").alias("shapley"),
    )
