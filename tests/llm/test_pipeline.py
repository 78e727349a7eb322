import random
from pathlib import Path

import corpus_pipeline
from test_packing import check

import brute
from samples import odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def expected(rows):
    """Ids that reach the packing: lettered, one of equal texts, one of near copies."""
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = [(i, t) for (i, t), (_, keep, _) in zip(left, brute.exact_groups(left), strict=True) if i == keep]
    texts = dict(kept)
    return {i: texts[i] for i, (_, component) in brute.near_groups(texts).items() if i == component}


def test_run_equals_brute_force(spark, texts):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = expected(list(texts.items()))
    check(rows, want)
    assert {r["doc_id"] for r in rows} == set(want)


def test_stages_work_on_odd_rows(spark, odd, nothing):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, "/nowhere"), name)
        assert docs.columns == odd.columns
    ids = sorted((r["doc_id"] for r in docs.collect()), key=str)
    assert ids == sorted([1, 6, 8, 9, 10, None], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").collect()
    check(packed, {r[0]: r[1] for r in odd_rows() if r[0] in (1, 6, 8, 9, 10)})
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/nowhere")
        assert empty.count() == 0


def near_copies():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows.append((3 * i, " ".join(words), "en", "a"))
        rows.append((3 * i + 1, " ".join([*words, "more"]), "en", "b"))
        rows.append((3 * i + 2, " ".join(words) + " ", "en", "b"))
    rows += [(None, rows[0][1], "en", "a"), (None, None, "en", "a"), (0, rows[0][1], "en", "a")]
    return rows


def left_behind(spark, work):
    """Kinds of the tables in the shared folder that were not there before ``work``."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    result = work()
    return result, {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before}


def test_dedup_stages_leave_only_what_their_result_reads(spark):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string, lang string, source string")
    near, left = left_behind(spark, lambda: corpus_pipeline.near_dedup(spark, docs, "/nowhere"))
    assert left == {"near-dropped"}
    got = sorted((r["doc_id"] for r in near.collect()), key=str)
    assert got == sorted([*range(0, 180, 3), 0, None, None], key=str)
    exact, left = left_behind(spark, lambda: corpus_pipeline.exact_dedup(spark, docs, "/nowhere"))
    assert left == {"exact-kept"}
    assert exact.count() == 121


def test_near_dedup_does_not_deal_out_the_texts_for_few_copies(spark, tmp_path):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    many = spark.range(1000, 200_000).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'a' AS source")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        near = corpus_pipeline.near_dedup(spark, docs.unionByName(many), "/nowhere")
        assert "SortMergeJoin" not in near._jdf.queryExecution().sparkPlan().toString()
        assert near.count() == 199_000 + 63
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_run_keeps_the_last_stage_only(spark, tmp_path):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, left = left_behind(spark, lambda: corpus_pipeline.run(spark, str(tmp_path)))
    assert {x for x in left if x.startswith("pipeline-")} == {"pipeline-packing"} and rows.count()
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 183


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "mixing", "packing",
    ]
