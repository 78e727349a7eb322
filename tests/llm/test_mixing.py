from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from samples import odd_rows
from logsluice.llm.mixing import mix_rows, mix_schedule, phases, quotas, schedule


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(1e-6, 1e6), min_size=1, max_size=30))
def test_every_deadline_is_met_and_no_source_is_a_block_off(weights):
    quota = quotas(weights, 128)
    period = sum(quota.values())
    assert min(quota.values()) >= 1 and period == max(128, 4 * len(weights))
    done = Counter()
    slots = schedule(quota)
    assert [s[-1] for s in slots] == list(range(period))
    for source, block, release, deadline, slot in slots:
        assert release <= slot < deadline and block == done[source]
        done[source] += 1
        for s, q in quota.items():
            assert abs(done[s] - (slot + 1) * q / period) < 1
    assert done == quota


def test_phases_use_up_every_block():
    blocks, weights = {"a": 1000, "b": 10, "c": 333}, {"a": 1.0, "b": 1.0, "c": 2.0}
    made = phases(blocks, weights, 16)
    ends = {s: 0 for s in blocks}
    for _, first, quota, end in made:
        for s in first:
            assert first[s] == ends[s] and end[s] > first[s]
            ends[s] = end[s]
        total = sum(weights[s] for s in first)
        assert all(abs(quota[s] - weights[s] / total * sum(quota.values())) < 1 for s in first)
    assert ends == blocks and len(made) <= 3


def test_stream_follows_the_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'big' WHEN id % 2 = 0 THEN 'mid' ELSE 'low' END AS source")
    weights = {"big": 0.5, "mid": 0.3, "low": 0.2}
    rows = sorted(mix_schedule(docs, weights, block_rows=4).collect(), key=lambda r: r["position"])
    assert len({r["position"] for r in rows}) == 6000 and {r["doc_id"] for r in rows} == set(range(6000))
    done, first = Counter(), [r for r in rows if r["phase"] == 0]
    assert len(first) > 3000
    blocks = []
    for r in first:
        if not blocks or blocks[-1] != (r["source"], r["block"], r["slot"]):
            blocks.append((r["source"], r["block"], r["slot"]))
    for source, block, slot in blocks[: 600]:
        assert block == done[source]
        done[source] += 1
        for s in weights:
            share = next(r["target_weight"] for r in first if r["source"] == s)
            assert abs(share - weights[s]) < 1 / 500
            assert abs(done[s] - (slot + 1) * share) < 1
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and r["position"] // 4 == r["slot"]
    per_block = Counter((r["source"], r["block"]) for r in rows)
    short = defaultdict(int)
    for (source, _), n in per_block.items():
        short[source] += n < 4
    assert max(per_block.values()) == 4 and max(short.values()) <= 1


def test_rows_come_in_order_with_all_columns(spark, odd, nothing, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 3) AS source")
    want = [r["doc_id"] for r in sorted(mix_schedule(docs).collect(), key=lambda r: r["position"])]
    mix_rows(docs).write.parquet(f"{tmp_path}/mixed")
    files = sorted(tmp_path.glob("mixed/part-*"))
    got = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == want
    mixed = mix_rows(odd)
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r[0] for r in odd_rows())
    assert mix_rows(nothing).count() == 0 and mix_schedule(nothing).count() == 0


def test_whole_rows_are_dealt_twice_only(spark, tmp_path):
    """To be numbered and to their place, as planned, before any table's size is measured."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 3) AS source")
    docs.write.parquet(f"{tmp_path}/docs")
    plan = mix_rows(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 3


def test_odd_rows_and_weights(odd):
    rows = mix_schedule(odd).collect()
    assert len(rows) == 13 and len({r["position"] for r in rows}) == 13
    given_weights = mix_schedule(odd, {"a": 1, "b": 1, "c": 1, None: 1}).collect()
    assert {round(r["target_weight"], 3) for r in given_weights if r["phase"] == 0} == {0.25}
    with pytest.raises(ValueError, match="no weight"):
        mix_schedule(odd, {"a": 1})
