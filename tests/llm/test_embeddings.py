import numpy as np
import pytest

from logsluice.llm import embeddings
from logsluice.llm.embeddings import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, n string, component string, kept string"


def plain(rows):
    """{id: (links, component)} by comparing all pairs of a label."""
    ids = [r[0] for r in rows]
    out = {}
    for label in {r[2] for r in rows if r[2] is not None}:
        part = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in part], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        linked = x @ x.T >= 0.98
        np.fill_diagonal(linked, False)
        component = np.array([r[0] for r in part])
        while True:
            new = np.minimum(component, np.where(linked, component[None, :], max(ids)).min(axis=1))
            if (new == component).all():
                break
            component = new
        for r, n, c in zip(part, linked.sum(axis=1), component, strict=True):
            out[r[0]] = (int(n), int(c))
    return out


def made(seed, groups, label):
    """Groups of noisy copies among single vectors; in one group the noise is near the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        centre = rng.normal(size=16)
        noise = rng.choice([0.0, 0.01, 0.1, 0.14])
        for _ in range(size):
            rows.append((centre + noise * rng.normal(size=16)) * rng.choice([0.1, 1, 30]))
    return [(seed * 10_000 + i, [float(np.float32(v)) for v in x], label) for i, x in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rows = made(1, [1] * 80 + [2] * 20 + [5] * 6 + [150], 1) + made(2, [1] * 50 + [30, 3], 2)
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(table).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_given_table_exactly(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(table).collect()}
    assert got == plain(rows)


def test_starting_graph_finds_isolated_pairs_of_a_dense_label(spark):
    """Single vectors fill a cone, as a large label fills the sphere; pairs have no other neighbour."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x = 2.2 * rng.normal(size=64) + x
    x[1::20] = x[::20] + 0.4 * rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = {(20 * i, 20 * i + 1) for i in range(300) if x[20 * i] @ x[20 * i + 1] >= 0.98}
    assert len(pairs) > 200
    rows = [(i, "1", 64, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, dim int, vec array<double>")
    found = {(r["a"], r["b"]) for r in embeddings.starting_graph(vectors).collect()}
    assert len(found & pairs) >= 0.9 * len(pairs)


def test_audit_counts_each_vector_once(spark):
    """All links of one large group are found, and none of the 30 pairs."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 16)), 2, axis=0)
    x = np.concatenate((np.repeat(rng.normal(size=(1, 16)), 200, axis=0), x))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, "1", 16, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, dim int, vec array<double>")
    labels = spark.createDataFrame([(i, 0) for i in range(200)], "vec_id long, component long")
    assert abs(embeddings.audit(vectors, labels, 10_000) - 200 / 260) < 1e-9


def test_missed_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "audit", lambda *_: 0.5)
    monkeypatch.setattr(embeddings, "ATTEMPTS", 1)
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in made(1, [2, 2], 1)], SCHEMA)
    with pytest.raises(RuntimeError, match="recall by vector is 0.500"):
        near_duplicate_vectors(table)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1),
        (10, [1.0, None], 1),
        (11, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1),
        (12, [1e-30, 0.0], 1),
        (13, [3e38, 3e37], 1),
    ]
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    found = near_duplicate_vectors(table).collect()
    assert len(found) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[12] == (4, 1, False) and got[13] == (4, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert got[None] == (0, None, True)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [300])
def test_equal_vectors_are_one(spark, copies):
    table = spark.createDataFrame([(i, [0.5, 1.0], 7) for i in range(copies)], "vec_id long, embedding array<float>, label int")
    found = near_duplicate_vectors(table).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(copies - 1, 0)}
