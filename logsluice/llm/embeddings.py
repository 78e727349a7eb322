"""Near-duplicate embeddings: a neighbour graph refined by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import hash_unit, pick, shuffle_tasks, stored
from logsluice.llm.components import components

THRESHOLD = 0.98
# Neighbours under this similarity are of no use on the way to a link.
FLOOR = 0.9
NEIGHBOURS = 8
# Starting neighbours: sort orders by a random signature, and how far they reach. Signatures are
# compared from their first bit on and are longer than any label needs to part its vectors.
ORDERS = 16
SIGNATURE = 60
REACH = 3
WIDEST = 64
ROUNDS = 6
# Vectors that the audit compares with all others, at most about, and how many at once.
AUDIT = 1024
AUDIT_PART = 128
ATTEMPTS = 3
BLOCK = 512
TARGET_RECALL = 0.9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    rows = [np.asarray(x.values) for x in column]
    return np.stack(rows) if rows else np.zeros((0, 0))


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec): vectors of length 1 in double precision; vec null where a row links with nothing."""
    base = pick(table, vec_id="long", embedding="array<double>", label="string")
    finite = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    largest = F.array_max(F.transform("embedding", F.abs))
    scaled = F.transform("embedding", lambda x: x / largest)
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    return (
        base.withColumn("good", finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
        .withColumn("good", F.col("good") & F.coalesce(largest > 0, F.lit(False)))
        .withColumn("scaled", F.when(F.col("good"), scaled))
        .select(
            "vec_id",
            "label",
            F.size("embedding").alias("dim"),
            F.when(F.col("good"), F.transform("scaled", lambda x: x / length)).alias("vec"),
        )
    )


def _keys(dim: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7919 * turn + dim))
    return draw.normal(size=(SIGNATURE, dim)), draw.normal(size=dim)


def _ordered(batches: Iterator[pa.RecordBatch], attempt: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for every order: the signs of random projections, then one projection."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(at))
            x = _matrix(part.column(3))
            for turn in range(attempt * ORDERS, (attempt + 1) * ORDERS):
                planes, line = _keys(int(dim), turn)
                sign = ((x @ planes.T > 0) << np.arange(SIGNATURE)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), turn, np.int32)),
                        part.column(1),
                        part.column(2),
                        pa.array(sign.astype(np.int64)),
                        pa.array(x @ line),
                        part.column(0),
                        part.column(3),
                    ],
                    ["turn", "label", "dim", "sign", "along", "vec_id", "vec"],
                )


ORDERED = "turn int, label string, dim int, sign long, along double, vec_id long, vec array<double>"
EDGES = "a long, b long, sim double"


def _slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of each row with the REACH next ones of its order.

    Neighbours share as many bits of the signature as their label's size and density there
    leave room for, so a pair does not drown in a bucket as the label grows.
    """
    held: list[tuple] = []
    for batch in batches:
        new = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True))
        rows = held + [
            (key[:3], key[4], np.asarray(v.values)) for key, v in zip(new, batch.column(6), strict=True)
        ]
        first, out = len(held), []
        for reach in range(1, REACH + 1):
            pairs = [(i - reach, i) for i in range(max(first, reach), len(rows)) if rows[i][0] == rows[i - reach][0]]
            if pairs:
                x, y = (np.stack([rows[p[s]][2] for p in pairs]) for s in (0, 1))
                sims = np.einsum("ij,ij->i", x, y)
                out += [
                    (rows[i][1], rows[j][1], s) for (i, j), s in zip(pairs, sims.tolist(), strict=True) if s >= FLOOR
                ]
        held = rows[-REACH:]
        yield _edges(out)


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "sim"]
    )


def starting_graph(vectors: DataFrame, attempt: int = 0) -> DataFrame:
    """First neighbours: close in one of several random sort orders (no group is gathered in a task)."""
    spread = vectors.select("vec_id", "label", "dim", "vec").mapInArrow(lambda x: _ordered(x, attempt), ORDERED)
    keys = ["turn", "label", "dim", "sign", "along", "vec_id"]
    return (
        spread.repartitionByRange(shuffle_tasks(vectors.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_slide, EDGES)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
        .dropDuplicates(["a", "b"])
    )


def _dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = zip(batch.column(2), batch.column(3), strict=True)
            sims = np.array([np.dot(np.asarray(x.values), np.asarray(y.values)) for x, y in rows])
            keep = pa.array(sims >= FLOOR)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sims).filter(keep)],
                ["a", "b", "sim"],
            )


def similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs (a, b) with a similarity of FLOOR or more."""
    for name in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("vec_id").alias(name), F.col("vec").alias(f"v_{name}")), name)
    return pairs.select("a", "b", "v_a", "v_b").mapInArrow(_dot, EDGES)


def _nearest(edges: DataFrame, width: DataFrame | None) -> DataFrame:
    """(a, b, sim, rank, width): each vector's nearest neighbours, as many as its list is wide."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    lists = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WIDEST)
    if width is None:
        lists = lists.withColumn("width", F.lit(NEIGHBOURS))
    else:
        lists = lists.join(width, lists["a"] == width["w"], "left").withColumn(
            "width", F.coalesce(F.col("wide"), F.lit(NEIGHBOURS))
        )
    return lists.where(F.col("rank") <= F.col("width")).select("a", "b", "sim", "rank", "width")


def descend(edges: DataFrame, vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Refines a neighbour graph (a < b, sim) until it hardly changes.

    In each round every vector meets its neighbours' neighbours, and the neighbours of
    one vector meet each other: at most 2 * width ** 2 pairs a vector. A list that
    is full of links is saturated and gets twice as wide, up to WIDEST.
    """
    width = None
    for _ in range(rounds):
        near = stored(_nearest(edges, width), "nearest")
        left = near.select(F.col("a").alias("p"), F.col("b").alias("x"))
        right = near.select(F.col("a").alias("p"), F.col("b").alias("y"))
        onward = near.select(F.col("b").alias("p"), F.col("a").alias("x"))
        met = left.join(right, "p").unionByName(onward.join(right, "p")).where("x <> y")
        met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = stored(similarities(met.join(edges, ["a", "b"], "left_anti"), vectors), "new-neighbours")
        before, found = edges.count(), new.count()
        full = near.groupBy(F.col("a").alias("w"), "width").agg(
            F.sum(F.when(F.col("sim") >= THRESHOLD, 1).otherwise(0)).alias("linked")
        )
        wide = F.least(F.col("width") * F.when(F.col("linked") >= F.col("width"), 2).otherwise(1), F.lit(WIDEST))
        width = stored(full.select("w", wide.alias("wide")).where(F.col("wide") > NEIGHBOURS), "list-widths")
        if not found:
            break
        edges = stored(edges.unionByName(new), "neighbours")
        if found * 1000 < before:
            break
    return edges


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each pair of blocks: rows come sorted by (component, i, j)."""

    def count(key: tuple, rows: list[tuple]) -> list[tuple]:
        x = np.stack([r[2] for r in rows])
        block, many = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        linked = x @ x.T >= THRESHOLD
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:
            linked &= block[:, None] != block[None, :]
        return list(zip([r[0] for r in rows], (linked @ many).tolist(), strict=True))

    key, rows, out = None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for at, new in enumerate(zip(*columns[:3], strict=True)):
            if new != key:
                if rows:
                    out += count(key, rows)
                key, rows = new, []
            vec = np.asarray(batch.column(6)[at].values)
            rows.append((columns[3][at], columns[4][at], vec, columns[5][at]))
        if len(out) > 10_000:
            yield _counted(out)
            out = []
    if rows:
        out += count(key, rows)
    yield _counted(out)


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    ids, n = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["vec_id", "n"])


def links_in_components(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(vec_id, n): links of each vector to others of its component, counted in pairs of blocks.

    A component of any size is cut into blocks of about BLOCK vectors, so a task holds
    two of them. Pairs are counted, never listed.
    """
    sizes = stored(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (
        labels.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(vectors.select("vec_id", "many", "vec"), "vec_id")
        .select(
            "component",
            F.least("block", "with").alias("i"),
            F.greatest("block", "with").alias("j"),
            "vec_id",
            "block",
            "many",
            "vec",
        )
    )
    keys = ["component", "i", "j"]
    return (
        rows.repartition(shuffle_tasks(vectors.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_count_links, "vec_id long, n long")
        .groupBy("vec_id")
        .agg(F.sum("n").alias("n"))
    )


def audit(vectors: DataFrame, labels: DataFrame, queries: int | None = None) -> float:
    """Recall by vector: about ``queries`` vectors, by hash of their id, compared with all others.

    A true link is found if both ends lie in one component (links inside are counted
    exactly). Each chosen vector that has links counts once, with the share of them that is
    found, so a large group does not hide the small ones. 1.0 if no chosen vector has links.
    """
    queries = AUDIT if queries is None else queries
    total = vectors.count()
    if not total:
        return 1.0
    in_component = labels.select(F.col("vec_id").alias("__l"), "component")
    placed = vectors.join(in_component, F.col("vec_id") == F.col("__l"), "left").select(
        "vec_id", "label", "dim", "vec", F.coalesce("component", "vec_id").alias("component")
    )
    chosen = placed.where(hash_unit("vec_id", F.lit("audit")) < queries / total)
    asked = chosen.limit(4 * queries).collect()  # a bounded sample
    if not asked:
        return 1.0
    kinds: dict[tuple, list] = {}
    for r in asked:
        kinds.setdefault((r["label"], r["dim"]), []).append((r["vec_id"], r["vec"], r["component"]))
    held = {k: tuple(np.array(x) for x in zip(*v, strict=True)) for k, v in kinds.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, components_of = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            rows_of: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows_of.setdefault(kind, []).append(i)
            for kind, at in rows_of.items():
                if kind not in held:
                    continue
                x = _matrix(batch.column(3).take(pa.array(at)))
                for k in range(0, len(held[kind][0]), AUDIT_PART):
                    asked_ids, asked_x, asked_c = (part[k : k + AUDIT_PART] for part in held[kind])
                    linked = (asked_x @ x.T >= THRESHOLD) & (asked_ids[:, None] != ids[at][None, :])
                    found = linked & (asked_c[:, None] == components_of[at][None, :])
                    some = linked.any(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(asked_ids[some]),
                            pa.array(linked.sum(axis=1)[some]),
                            pa.array(found.sum(axis=1)[some]),
                        ],
                        ["vec_id", "links", "found"],
                    )

    told = placed.mapInArrow(compare, "vec_id long, links long, found long")
    shares = told.groupBy("vec_id").agg((F.sum("found") / F.sum("links")).alias("share"))
    recall = shares.agg(F.avg("share")).first()[0]
    return 1.0 if recall is None else recall


def near_duplicate_vectors(table: DataFrame) -> DataFrame:
    """Links of vectors with equal labels and a cosine of at least 0.98.

    Needs ``vec_id``, ``embedding`` and ``label``; other columns are ignored. Returns
    one row per row: vec_id, n_links, component_id, kept.

    1. Equal vectors of a label become one with a multiplicity.
    2. A starting graph links vectors that are close in random sort orders, by signatures that
       part a label of any size; NN-descent refines it. Both keep neighbours of FLOOR and more
       only, so a pair without other neighbours is found by the orders alone.
    3. Edges of at least 0.98 give components. Inside a component all links are
       counted exactly, block by block; saturated lists so lose nothing.
    4. The audit compares a bounded sample with all vectors, vector by vector. Under
       TARGET_RECALL, further random orders are added and descended from, at most ATTEMPTS
       times; if it is not reached then, that is an error.

    A vector that is null, zero, or holds nulls or non-finite numbers, or has a null label
    or vec_id, has no links and is its own component. Vectors of different lengths
    never link. Repeated rows link with each other and carry the same values; so do all
    rows that share a vec_id. An empty table gives no rows.
    """
    rows = stored(unit_vectors(table), "unit-vectors")
    usable = rows.where("vec IS NOT NULL")
    same = stored(
        usable.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")),
        "equal-vectors",
    )
    vectors = same.withColumnRenamed("rep", "vec_id")
    member = stored(usable.join(same, ["label", "dim", "vec"]).select("vec_id", "rep", "many"), "vector-members")

    edges = None
    for attempt in range(ATTEMPTS):
        start = starting_graph(vectors, attempt)
        if edges is not None:
            start = start.join(edges, ["a", "b"], "left_anti").unionByName(edges)
        edges = descend(stored(start, "neighbours"), vectors)
        found = components(edges.where(F.col("sim") >= THRESHOLD).select("a", "b"))
        labels = stored(found.select(F.col("node").alias("vec_id"), "component"), "components")
        recall = audit(vectors, labels)
        if recall >= TARGET_RECALL:
            break
    else:
        raise RuntimeError(f"recall by vector is {recall:.3f} after {ATTEMPTS} attempts, under {TARGET_RECALL}")
    linked = stored(links_in_components(vectors, labels), "link-counts")
    found = (
        member.join(labels.withColumnRenamed("vec_id", "__l"), F.col("rep") == F.col("__l"), "left")
        .join(linked.withColumnRenamed("vec_id", "__n"), F.col("rep") == F.col("__n"), "left")
        .groupBy(F.col("vec_id").alias("__id"))
        .agg(
            F.min(F.coalesce("component", "rep")).alias("component_id"),
            F.max(F.coalesce(F.col("n"), F.lit(0)) + F.col("many") - 1).alias("n_links"),
        )
    )
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return rows.join(found, rows["vec_id"] == found["__id"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
