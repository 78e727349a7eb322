"""Near-duplicates by HyperMinHash sketches, banding, and verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import forget, pick, stored
from logsluice.llm.components import components
from logsluice.llm.hashing import Slice, mix, shingles, text_slices, words_of

WORDS = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS = 128
ROWS_OF_BAND = 4
BANDS = REGISTERS // ROWS_OF_BAND
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
# Shingles for each register, at least, before a sketch uses twice the registers per pass.
LOAD = 4
TOP = 7  # the class of large sets: all 128 registers in one pass
# Estimates below this are not verified: over five standard errors under the threshold.
ESTIMATE = 0.55
# Hubs of a group after the first round, and rounds at most.
HUBS = 2
STAR_ROUNDS = 8
# Stars end with a round that joins less than this share of what the first one joined.
LAST_SHARE = 0.02
BLOCK = 2048
# Shingles of one block of full sets: 32 MB.
BLOCK_SHINGLES = 1 << 22

_random = np.random.Generator(np.random.PCG64(1))
SEEDS = _random.integers(1, 2**63, REGISTERS, dtype=np.uint64)


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets of LOAD * 2**c .. LOAD * 2**(c+1) - 1 shingles have class c, at most TOP, at least 0."""
    c = np.floor(np.log2(np.maximum(n, 1) / LOAD)).astype(np.int64)
    return np.clip(c, 0, TOP)


def sketch(hashes: np.ndarray, of: np.ndarray, rows: int, c: int) -> np.ndarray:
    """HyperMinHash registers (rows x REGISTERS) of class ``c``.

    A class-c sketch makes REGISTERS / 2**c passes with hash functions of their own; each
    pass deals the shingles over 2**c buckets. A register keeps the least 57-bit hash of
    its bucket in compressed form: its number of leading zeros (6 bits) and the
    MANTISSA bits after the leading one.
    """
    k = 1 << c
    least = np.full(rows * REGISTERS, np.uint64(2**64 - 1))
    for turn in range(REGISTERS // k):
        h = mix(hashes ^ SEEDS[turn])
        place = of * REGISTERS + turn * k + (h & np.uint64(k - 1)).astype(np.int64)
        np.minimum.at(least, place, h >> np.uint64(TOP))
    return compress(least).reshape(rows, REGISTERS)


def compress(least: np.ndarray) -> np.ndarray:
    """6 bits of leading zeros and MANTISSA bits of each 57-bit minimum."""
    bits = 64 - TOP
    found = least < np.uint64(1 << bits)
    value = np.where(found, np.maximum(least, np.uint64(1)), np.uint64(1))
    high = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    high -= (value >> high.astype(np.uint64)) == 0  # rounding up to the next power
    up = np.maximum(MANTISSA - high, 0).astype(np.uint64)
    down = np.maximum(high - MANTISSA, 0).astype(np.uint64)
    mantissa = ((value << up) >> down) & np.uint64((1 << MANTISSA) - 1)
    zeros = (bits - 1 - high).astype(np.uint64)
    return np.where(found, (zeros << np.uint64(MANTISSA)) | mantissa, EMPTY).astype(np.uint16)


def chance_collisions(load_a: np.ndarray, load_b: np.ndarray) -> np.ndarray:
    """Probability that two unrelated registers are equal, given the sets' shingles per bucket.

    The minimum of a bucket with load x is exponential with rate x on (0, 1). Within one
    number of leading zeros z all mantissa cells have the width 2**-(z+1+MANTISSA), so the
    probability is the integral of the product of both densities times that width.
    """
    both, total = load_a + load_b, np.zeros(np.shape(load_a))
    for z in range(40):
        low, high = 2.0 ** -(z + 1), 2.0**-z
        total += 2.0 ** -(z + 1 + MANTISSA) * (np.exp(-both * low) - np.exp(-both * high))
    return total * load_a * load_b / np.maximum(both, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows of one class: matches less the expected chance matches."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    guess = same / np.maximum(used, 1)
    near = guess >= ESTIMATE  # the correction only lowers it
    k = 2.0 ** c[near]
    wrong = chance_collisions(n_a[near] / k, n_b[near] / k)
    guess[near] = (guess[near] - wrong) / (1 - wrong)
    return guess


def bands(registers: np.ndarray, c: int) -> np.ndarray:
    """64-bit keys of the bands: four registers of 16 bits, with class and band; 0 where all are empty."""
    packed = np.ascontiguousarray(registers).view(np.uint64)
    keys = mix(packed ^ SEEDS[:BANDS][None, :] ^ np.uint64(c * 0x1F3D5B79))
    return np.where(packed == np.uint64(2**64 - 1), np.uint64(0), keys)


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, kind int, regs binary, low binary, bands array<long>"


def _sets(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, sorted by row, with their rows; and each row's number."""
    hashes, of = shingles(words_of(part), WORDS)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, of, np.bincount(of, minlength=part.hi - part.lo)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch.column(1)):
            rows = part.hi - part.lo
            hashes, of, n = _sets(part)
            kind = size_class(n)
            regs = np.full((rows, REGISTERS), EMPTY)
            low = np.full((rows, REGISTERS), EMPTY)
            keys = np.zeros((rows, 2 * BANDS), np.uint64)
            # Similar sets of neighbouring classes meet in the lower one.
            lower = (kind > 0) & (n * PERCENT < LOAD * (1 << kind) * 100)
            for target, where, column in ((regs, n > 0, 0), (low, lower, BANDS)):
                for c in np.unique(kind[where]):
                    chosen = where & (kind == c)
                    number = np.cumsum(chosen) - 1
                    mine = chosen[of]
                    c = int(c) - (column > 0)
                    made = sketch(hashes[mine], number[of[mine]], int(chosen.sum()), c)
                    target[chosen] = made
                    keys[chosen, column : column + BANDS] = bands(made, c)
            set_a = np.zeros(rows, np.uint64)
            np.add.at(set_a, of, mix(hashes ^ SEEDS[100]))
            set_b = np.zeros(rows, np.uint64)
            np.add.at(set_b, of, mix(hashes ^ SEEDS[101]))
            has = keys != 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.lo, rows),
                    pa.array(n.astype(np.int64)),
                    pa.array(set_a.view(np.int64)),
                    pa.array(set_b.view(np.int64)),
                    pa.array(kind.astype(np.int32)),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array([r.tobytes() if x else None for r, x in zip(low, lower, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(has.sum(axis=1))).astype(np.int32)),
                        pa.array(keys[has].view(np.int64)),
                    ),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "kind", "regs", "low", "bands"],
            )


def _registers(column: pa.Array) -> np.ndarray:
    empty = EMPTY.tobytes() * REGISTERS
    held = b"".join(x if x is not None else empty for x in column.to_pylist())
    return np.frombuffer(held, np.uint16).reshape(-1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate reaches ESTIMATE, with it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        kind_a, kind_b = cols["kind_a"].to_numpy(), cols["kind_b"].to_numpy()
        regs_a, regs_b = _registers(cols["regs_a"]), _registers(cols["regs_b"])
        a = np.where((kind_a > kind_b)[:, None], _registers(cols["low_a"]), regs_a)
        b = np.where((kind_b > kind_a)[:, None], _registers(cols["low_b"]), regs_b)
        guess = estimate(a, b, cols["n_a"].to_numpy(), cols["n_b"].to_numpy(), np.minimum(kind_a, kind_b))
        good = (np.abs(kind_a - kind_b) <= 1) & (guess >= ESTIMATE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols["a"].to_numpy()[good]), pa.array(cols["b"].to_numpy()[good]), pa.array(guess[good])],
            ["a", "b", "guess"],
        )


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Keeps the pairs (a, b) that the collision-corrected estimate does not rule out."""
    side = sketches.select("rep", "kind", "n_shingles", "regs", "low")
    for name in ("a", "b"):
        part = side.select(
            F.col("rep").alias(name),
            F.col("kind").alias(f"kind_{name}"),
            F.col("n_shingles").alias(f"n_{name}"),
            F.col("regs").alias(f"regs_{name}"),
            F.col("low").alias(f"low_{name}"),
        )
        pairs = pairs.join(part, name)
    return pairs.mapInArrow(_likely, "a long, b long, guess double")


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch.column(1)):
            hashes, of, n = _sets(part)
            ends = np.append(0, np.cumsum(n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.lo, part.hi - part.lo),
                    pa.array([hashes[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ],
                ["rep", "shingles"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        sides = batch.column(2), batch.column(3)
        for x, y in zip(*sides, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"]
        )


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union of their full sets.

    A hub's pairs are a skewed join key, which Spark splits; there is no grouping.
    """
    return (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b")), "b")
        .select("a", "b", "of_a", "of_b")
        .mapInArrow(_confirm, "a long, b long")
    )


def _across(key: tuple, rows: pa.Table) -> pa.Table:
    """Likely pairs of different components between the two sides of a block.

    A pair that shares several bands is made in the first of them only. Confirming a pair
    moves two full sets; a block with more than a pair for two of its rows is marked (a pair of nulls)
    instead: its rows' sets are brought to it once, and it confirms its own links.
    """
    band = np.array([key[0].as_py()], np.int64).view(np.uint64)[0]
    table = {n: rows[n].to_numpy() for n in ("rep", "component", "kind", "n", "side")}
    regs, low = _registers(rows["regs"]), _registers(rows["low"])
    right = np.flatnonzero(table["side"] == 1)
    found: list[np.ndarray] = []
    for i in np.flatnonzero(table["side"] == 0):
        j = right[table["component"][right] != table["component"][i]]
        j = j[np.abs(table["kind"][j] - table["kind"][i]) <= 1]
        if not len(j):
            continue
        ki, kj = int(table["kind"][i]), table["kind"][j]
        a = np.where((kj < ki)[:, None], low[i][None, :], regs[i][None, :])
        b = np.where((kj > ki)[:, None], low[j], regs[j])
        # Which band of which class this group is, for the left row.
        places = [
            (c, np.flatnonzero(bands(r[i : i + 1], c)[0] == band)) for r, c in ((regs, ki), (low, ki - 1)) if c >= 0
        ]
        at = [(c, p[0]) for c, p in places if len(p)]
        if not at:
            raise ValueError(f"row {table['rep'][i]} is in the group of a band that it does not have")
        here, place = at[0]
        shared = ((a == b) & (a != EMPTY)).reshape(len(j), BANDS, ROWS_OF_BAND).all(axis=2)
        first = (np.minimum(ki, kj) == here) & (shared.argmax(axis=1) == place)
        mine = first | ~shared.any(axis=1)
        j, kj, a, b = j[mine], kj[mine], np.broadcast_to(a, b.shape)[mine], b[mine]
        if not len(j):
            continue
        n_i = np.full(len(j), table["n"][i])
        good = j[estimate(a, b, n_i, table["n"][j], np.minimum(ki, kj)) >= ESTIMATE]
        x, y = np.full(len(good), table["rep"][i]), table["rep"][good]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        if 2 * sum(map(len, found)) > rows.num_rows:
            return pa.table([*(pa.array([k.as_py()]) for k in key), *(pa.nulls(1, pa.int64()),) * 2], schema=FOUND)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    place = [pa.array([k.as_py()] * len(pairs), t.type) for k, t in zip(key, FOUND, strict=False)]
    return pa.table([*place, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=FOUND)


FOUND = pa.schema([("band", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _linked(rows: pa.Table) -> pa.Table:
    """Confirmed links between the sides of a block: a forest over its components, at most one less than these.

    A set of n shingles has a similarity of PERCENT only with sets that share one of its n - ceil(n * PERCENT %) + 1
    rarest ones, and have it among theirs; rarity is that in the block. So only rows that
    meet there are compared, each left row with all of them at once, on full sets.
    """
    held = rows["shingles"].combine_chunks()
    n = np.array([len(x) // 8 for x in held.to_pylist()], np.int64)
    names, token, often = np.unique(
        np.frombuffer(b"".join(held.to_pylist()), np.uint64), return_inverse=True, return_counts=True
    )
    row = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((token, often[token], row))
    token = token[by]
    first = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(len(token)) - first[row]
    front = (place <= n[row] - -(-n[row] * PERCENT // 100)) & (often[token] > 1)
    left, right = (rows[side].to_numpy().astype(bool) for side in ("left", "right"))
    posted = np.flatnonzero(front & right[row])
    posted = posted[np.argsort(token[posted], kind="stable")]
    post_rows, post_tokens = row[posted], token[posted]
    _, part = np.unique(rows["component"].to_numpy(), return_inverse=True)
    root = np.arange(part.max(initial=-1) + 1)
    rep, links = rows["rep"].to_numpy(), []
    for i in np.flatnonzero(left):
        own = token[first[i] : first[i + 1]]
        asked = own[front[first[i] : first[i + 1]]]
        lo, hi = np.searchsorted(post_tokens, asked), np.searchsorted(post_tokens, asked, "right")
        met = [post_rows[a:b] for a, b in zip(lo, hi, strict=True) if a < b]
        if not met:
            continue
        j = np.unique(np.concatenate(met))
        j = j[(root[part[j]] != root[part[i]]) & (100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i]))]
        if not len(j):
            continue
        mine = np.zeros(len(names), bool)
        mine[own] = True
        ends = np.concatenate(([0], np.cumsum(n[j])))
        inside = np.arange(ends[-1]) + np.repeat(first[j] - ends[:-1], n[j])
        shared = np.add.reduceat(mine[token[inside]], ends[:-1], dtype=np.int64)
        for k in j[100 * shared >= PERCENT * (n[j] + n[i] - shared)]:
            a, b = root[part[i]], root[part[k]]
            if a != b:
                links.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                root[root == max(a, b)] = min(a, b)
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """Labels (rep, component) after joining the components of linked classes, and by how many pairs of them."""
    for name in ("a", "b"):
        side = labels.select(F.col("rep").alias(name), F.col("component").alias(f"c_{name}"))
        links = links.join(side, name)
    links = links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct()
    links = stored(links, "joined")
    pairs = links.count()
    if not pairs:
        forget(links)
        return labels, 0
    found = components(links)
    forget(links)
    new = labels.join(found, labels["component"] == found["node"], "left").select(
        "rep", F.coalesce(found["component"], labels["component"]).alias("component")
    )
    new = stored(new, "labels")
    forget(found)
    return new, pairs


def _star_pairs(groups: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a group paired with its hubs, across components: one hub first, later HUBS of them. And the stored hubs.

    Hubs are the least of each part of a group in an order that changes with the turn.
    """
    placed = groups.join(labels, "rep")
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "component")
    parts = 1 if turn == 0 else HUBS
    part = F.pmod(F.xxhash64("rep", F.lit(turn + 100)), F.lit(parts))
    hubs = placed.groupBy("band").agg(
        *(F.min(F.when(part == k, order)).alias(f"hub{k}") for k in range(parts)),
        F.min("component").alias("c0"),
        F.max("component").alias("c1"),
    )
    hubs = hubs.where("c0 <> c1").select("band", F.explode(F.array(*(f"hub{k}" for k in range(parts)))).alias("hub"))
    hubs = stored(hubs.where("hub IS NOT NULL"), "hubs")
    pairs = (
        placed.join(hubs, "band")
        .where("component <> hub.component")
        .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
        .distinct()
    )
    return pairs, hubs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents whose 5-word shingle sets are at least 75 % alike.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per
    row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links,
    itself included), kept (doc_id = component_id).

    1. Each document gets its set size, a 128-bit sum of its set, HyperMinHash registers
       and band keys. Equal sets meet by the sum and go on as one class.
    2. Classes with an equal band key form a group. A group's rows are paired with its
       smallest member (a star, not all pairs), the pairs are estimated from the
       registers, and each class has its likeliest link confirmed on full sets.
    3. Where rows of a group that had likely partners still lie in different components,
       stars are drawn again from HUBS other members and all their likely links are confirmed, as long as that
       joins much (at most STAR_ROUNDS times). Then rows of a group that
       lie in different components are compared in blocks of registers, all that
       is left to compare; likely pairs are confirmed, in the block itself where they are many. So no pair that
       shares a band is left out: it is in one component, ruled out by the estimate or its size, or compared on full sets.

    At a similarity of 0.75 a pair shares one of the 32 bands with probability
    1 - 5e-6. Nulls: a text without words has size 0 and links with nothing, a null doc_id
    neither (it is its own component, null, and kept). Rows repeated with their doc_id have
    one component; an id stands for one text. An empty table gives no rows.
    """
    base = pick(docs, doc_id="long", text="string")
    rows = stored(base.mapInArrow(_sketches, SKETCH), "sketches")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = stored(same, "equal-sets")
    member = stored(
        usable.select("doc_id", "set_a", "set_b", "n_shingles")
        .join(same, ["set_a", "set_b", "n_shingles"])
        .select("doc_id", "rep"),
        "set-members",
    )
    reps = same.select("rep")
    sketches = stored(
        usable.join(reps, usable["doc_id"] == reps["rep"]).dropDuplicates(["rep"]).drop("set_a", "set_b", "doc_id"),
        "class-sketches",
    )
    sizes = stored(rows.select("doc_id", "n_shingles"), "set-sizes")
    forget(rows)
    keyed = sketches.select("rep", F.explode("bands").alias("band"))
    many = keyed.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"))
    many = stored(many.where("hub <> far").select("band"), "bands")
    groups = stored(keyed.join(many, "band"), "band-groups")
    forget(many)

    nodes = groups.select("rep").distinct()
    labels = stored(nodes.select("rep", F.col("rep").alias("component")), "labels")
    sets = stored_sets(base, nodes)
    first, stars = 0, groups
    for turn in range(STAR_ROUNDS):
        pairs, hubs = _star_pairs(stars, labels, turn)
        likeliest = found = stored(likely(pairs, sketches), "likely")
        forget(hubs)
        last = stars, labels
        # Later stars are drawn among the classes that had a likely partner.
        ends = found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        stars = stored(stars.join(ends, "rep"), "stars")
        if turn == 0:
            # Each class tries its likeliest link; what that does not join comes up again.
            both = found.select(F.col("a").alias("x"), "a", "b", "guess").unionByName(
                found.select(F.col("b").alias("x"), "a", "b", "guess")
            )
            found = both.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("guess", "a", "b")).alias("p"))
            found = found.select("p.a", "p.b").distinct()
        links = stored(confirmed(found.select("a", "b"), sets), "confirmed")
        labels, joined = _joined(labels, links)
        forget(likeliest, links, *(old for old in last if old is not groups and old is not labels))
        first = joined if turn == 0 else first
        if turn and joined <= first * LAST_SHARE:
            break
    left = _left_links(groups, labels, sketches, sets, smallest=3 if STAR_ROUNDS > 1 else 2)
    last, (labels, _) = labels, _joined(labels, left)
    found = member.join(labels, "rep", "left").select(
        F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("component_id")
    )
    found = stored(found.groupBy("__id").agg(F.min("component_id").alias("component_id")), "components")
    forget(same, member, sketches, groups, stars, sets, left, last, labels)
    id_of = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return sizes.join(found, sizes["doc_id"] == found["__id"], "left").select(
        "doc_id", "n_shingles", id_of.alias("component_id"), F.col("doc_id").eqNullSafe(id_of).alias("kept")
    )


def stored_sets(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets of the classes that share a band with another one."""
    wanted = nodes.select(F.col("rep").alias("__rep"))
    texts = base.join(wanted, base["doc_id"] == wanted["__rep"], "left_semi")
    return stored(texts.mapInArrow(_set_bytes, "rep long, shingles binary").dropDuplicates(["rep"]), "shingle-sets")


def _left_links(groups: DataFrame, labels: DataFrame, sketches: DataFrame, sets: DataFrame, smallest: int) -> DataFrame:
    """Confirmed links across components in groups that the stars did not join, by pairs of blocks.

    Of a group, only the rows outside its largest component are compared with the others, so a
    group that is joined but for a few rows costs a few comparisons a row. Both sides
    are cut into blocks of about BLOCK rows. Groups under ``smallest`` need none: a
    pair is a star. Blocks with few likely pairs give these to be confirmed. Those with many get their
    rows' full sets, cut further if these hold more than BLOCK_SHINGLES, and give a forest of links; so no step
    has more rows than twice those of the blocks, however many pairs are likely.
    """
    placed = groups.join(labels, "rep")
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    wide = parts.groupBy("band").agg(
        F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")
    )
    wide = wide.where((F.col("parts") > 1) & (F.col("rows") >= smallest))
    others = (F.col("rows") - F.col("top.n")).alias("others")
    wide = stored(wide.select("band", "rows", others, F.col("top.component").alias("largest")), "left-groups")
    rows = placed.join(wide, "band").withColumns(
        {
            "lefts": F.ceil(F.col("others") / BLOCK).cast("int"),
            "rights": F.ceil(F.col("rows") / BLOCK).cast("int"),
            "h": F.xxhash64("rep"),
        }
    )

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["band", "i", "j", "side", "rep", "component"]
    left = rows.where(F.col("component") != F.col("largest")).withColumn("i", F.pmod("h", "lefts").cast("int"))
    left = left.withColumn("j", every("rights")).withColumn("side", F.lit(0)).select(*columns)
    right = rows.withColumn("j", F.pmod("h", "rights").cast("int"))
    right = right.withColumn("i", every("lefts")).withColumn("side", F.lit(1)).select(*columns)
    blocks = stored(left.unionByName(right), "left-blocks")
    held = sketches.select("rep", "kind", F.col("n_shingles").alias("n"), "regs", "low")
    compared = blocks.join(held, "rep").groupBy("band", "i", "j")
    found = stored(compared.applyInArrow(_across, "band long, i int, j int, a long, b long"), "left-pairs")
    few = confirmed(found.where("a IS NOT NULL").select("a", "b").distinct(), sets)

    key = ["band", "i", "j"]
    full = found.where("a IS NULL").select(*key)
    sides = (
        blocks.join(full, key)
        .groupBy(*key, "rep", "component")
        .agg(F.max(F.col("side") == 0).alias("left"), F.max(F.col("side") == 1).alias("right"))
    )
    sides = stored(sides, "full-blocks")
    cuts = sides.join(sketches.select("rep", "n_shingles"), "rep").groupBy(*key)
    cuts = cuts.agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("cuts"))
    cut = sides.join(cuts, key).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), "cuts").cast("int"))
    lefts = cut.where("left").select("*", F.col("own").alias("u"), every("cuts").alias("v"), F.lit(True).alias("l"), F.lit(False).alias("r"))
    rights = cut.where("right").select("*", every("cuts").alias("u"), F.col("own").alias("v"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    key += ["u", "v"]
    whole = lefts.unionByName(rights).groupBy(*key, "rep", "component").agg(F.max("l").alias("left"), F.max("r").alias("right"))
    many = whole.join(sets, "rep").groupBy(*key).applyInArrow(_linked, "a long, b long")
    links = stored(few.unionByName(many), "left-links")
    forget(wide, blocks, found, sides)
    return links
