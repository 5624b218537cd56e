"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors are one class first. A tree splits at the median of a random projection, level by level, until
leaves have about ``LEAF`` rows; rows near a split take both sides. Cuts are fitted on a bounded sample of
``SAMPLE`` classes (drawn by digest), the trees go to every task, and every row is placed in all of them.

How near is a node's own measure: at least ``SPILL``, and so wide that of up to ``PROBE_LINKS`` links between
``PROBES`` sampled rows of the node at most a share of ``MOST_PARTED / depth`` is parted. The cut leaves the
median, within the middle 40 % of the rows, where that spares much overlap. A node where most rows, or most
ends of links, would still take both sides is not split, so a dense group stays whole.

Inside a leaf all pairs are compared by cosine in double precision. Large leaves are cut into blocks and
the pairs of blocks are tasks of their own, so no task holds more than two blocks. A pair is counted in the
first leaf it shares, whatever the number of others. Leaves give counts per vector and a spanning forest of
their links, never the pairs; components by alternating large-star and small-star.

A pair at cosine 0.9 is parted by one tree of depth 8 with a probability of about 0.35 in 64 dimensions, by
all ``TREES`` with about 2e-4; the spill of a node keeps the links of a hot group near that at any depth.
Vectors that are null, zero, or hold a null or non-finite component link with nothing, as do vectors of
different lengths. Rows that repeat an id and a vector are one; an id with several vectors takes part with
the smallest. Rows with a null id are left out. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.common import stored
from stationcast.llm.components import components

TREES = 8
LEAF = 512
SPILL = 0.02
SAMPLE = 65_536
SAMPLE_LEAF = 16
MOST_SPILLED = 0.6
MOST_PARTED = 0.35
PROBES = 256
PROBE_LINKS = 1000
QUANTILES = (0.5, 0.4, 0.6, 0.3, 0.7)
BLOCK = 1024


def unit(m: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares of very small or large values stay in range.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _cut(h: np.ndarray, links: np.ndarray, parted: float, spill: float) -> tuple[float, float] | None:
    """Cut and spill of a node with heights ``h`` and sampled links (rows of two positions); None leaves it whole."""
    best, ends = None, h[links]
    quantiles = QUANTILES if len(links) else QUANTILES[:1]
    for q, cut in zip(quantiles, np.quantile(h, quantiles).tolist()):
        own = spill
        if len(links):
            # A link is parted where the nearer of its ends is further from the cut than the spill, on the other side.
            margin = np.minimum(cut - ends.min(axis=1), ends.max(axis=1) - cut)
            own = max(spill, float(np.quantile(margin, 1 - parted, method="higher")))
        both = np.abs(h - cut) <= own
        share = max(both.mean(), (np.abs(ends - cut) <= own).mean() if len(links) else 0.0)
        if share <= MOST_SPILLED and (best is None or share + abs(q - 0.5) < best[0]):
            best = share + abs(q - 0.5), cut, own
    return best and best[1:]


def grow_forest(
    sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 3, threshold: float = 0.9
) -> list[dict]:
    """Trees of directions (one per level) and a cut and a spill per node; nodes are numbered 1, 2 * n, 2 * n + 1."""
    depth = max(0, min(math.ceil(math.log2(max(1, rows) / leaf)), int(math.log2(max(1, len(sample) / SAMPLE_LEAF)))))
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        directions = rng.normal(size=(depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        heights = sample @ directions.T
        cuts, nodes = np.full(1 << depth, np.nan), {1: np.arange(len(sample))}
        spills = np.full(1 << depth, spill)
        for level in range(depth):
            below = {}
            for node, at in nodes.items():
                h = heights[at, level]
                if len(h) < 2:
                    continue
                probes = np.arange(len(at)) if len(at) <= PROBES else rng.choice(len(at), PROBES, replace=False)
                near = sample[at[probes]]
                i, j = np.nonzero(np.triu(near @ near.T >= threshold, 1))
                if len(i) > PROBE_LINKS:
                    drawn = rng.choice(len(i), PROBE_LINKS)
                    i, j = i[drawn], j[drawn]
                found = _cut(h, np.stack([probes[i], probes[j]], axis=1), MOST_PARTED / depth, spill)
                if found is None:
                    continue
                cut, own = cuts[node], spills[node] = found
                below[2 * node], below[2 * node + 1] = at[h <= cut + own], at[h >= cut - own]
            nodes = below
        forest.append({"directions": directions, "cuts": cuts, "spills": spills})
    return forest


def leaves_of(forest: list[dict], m: np.ndarray) -> list[list[int]]:
    """Leaf ids of every row: tree number in the upper bits, node in the lower."""
    found: list[list[int]] = [[] for _ in range(len(m))]
    for number, tree in enumerate(forest):
        heights = m @ tree["directions"].T
        rows, nodes = np.arange(len(m)), np.ones(len(m), np.int64)
        for level in range(len(tree["directions"]) + 1):
            cut = np.where(nodes < len(tree["cuts"]), tree["cuts"][np.minimum(nodes, len(tree["cuts"]) - 1)], np.nan)
            done = np.isnan(cut)
            for r, n in zip(rows[done].tolist(), nodes[done].tolist()):
                found[r].append((number << 40) | n)
            if done.all():
                break
            rows, nodes, cut = rows[~done], nodes[~done], cut[~done]
            h = heights[rows, level]
            spill = tree["spills"][nodes]
            left, right = h <= cut + spill, h >= cut - spill
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
    return found


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    table = table.combine_chunks()
    ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    values = table.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(ids), -1)
    return ids, copies, unit(values), table.column("leaves").to_pylist()


def _padded(leaves: list[list[int]], leaf: int) -> np.ndarray:
    """(rows, slots) leaves before ``leaf``, in earlier trees or by spill in the same one; -1 fills up."""
    early = [[x for x in row if x < leaf] for row in leaves]
    width = max([1, *map(len, early)])
    return np.array([row + [-1] * (width - len(row)) for row in early], np.int64)


def compare_blocks(threshold: float):
    """Links between two blocks of one leaf, or inside one: counts per row, and a spanning forest of the links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        ids, copies, m, leaves = _rows(table)
        part = table.column("part").to_numpy()
        left = np.flatnonzero(part == first)
        right = left if first == second else np.flatnonzero(part == second)
        early = _padded(leaves, key[0].as_py())
        counts = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges_a, edges_b = [], []
        for start in range(0, len(left), 256):
            rows = left[start : start + 256]
            i, j = np.nonzero(m[rows] @ m[right].T >= threshold)
            i, j = rows[i], right[j]
            once = i < j if first == second else np.ones(len(i), bool)
            i, j = i[once], j[once]
            shared = np.zeros(len(i), bool)
            for s in range(early.shape[1]):
                one = early[i, s][:, None]
                shared |= ((one == early[j]) & (one >= 0)).any(axis=1)
            i, j = i[~shared], j[~shared]
            counts += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(x), top(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges_a.append(x)
                    edges_b.append(y)
        linked = np.flatnonzero(counts)
        a = np.concatenate([ids[linked], ids[edges_a]]) if len(linked) else ids[:0]
        b = np.concatenate([np.full(len(linked), -1), ids[edges_b]]) if len(linked) else ids[:0]
        n = np.concatenate([counts[linked], np.zeros(len(edges_a), np.int64)]) if len(linked) else counts[:0]
        is_edge = np.concatenate([np.zeros(len(linked), bool), np.ones(len(edges_a), bool)]) if len(linked) else np.zeros(0, bool)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(is_edge)], ["a", "b", "n", "is_edge"])

    return run


def link_vectors(
    spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
    trees: int = TREES, leaf: int = LEAF, spill: float = SPILL,
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per id of ``df``."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = source.where(F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False)))
    usable = usable.groupBy("id").agg(F.min("v").alias("v"))
    classes = stored(
        spark,
        usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("v")),
        "vector_classes",
    )
    kinds = [(r.dims, r.n) for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()]
    found = None
    for dims, n in kinds:
        own = classes.where(F.col("dims") == dims)
        sample = own.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select(F.col("v").cast("array<float>").alias("v")).toArrow()
        values = sample.column("v").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        matrix = unit(values.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims) + 1e-300)
        sent = spark.sparkContext.broadcast(grow_forest(matrix, n, trees, leaf, spill, threshold=threshold))

        def place(batches, sent=sent, dims=dims):
            for batch in batches:
                if batch.num_rows:
                    m = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)
                    yield batch.append_column("leaves", pa.array(leaves_of(sent.value, unit(m)), pa.list_(pa.int64())))

        kind = classes.schema["v"].dataType.simpleString()
        placed = own.select("rep", "copies", "v").mapInArrow(place, f"rep long, copies long, v {kind}, leaves array<bigint>")
        spread = placed.withColumn("leaf", F.explode("leaves"))
        # A leaf with more than BLOCK rows is dealt into parts by digest; pairs of parts are groups of their own.
        parts = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
            F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("members")
        ).where("members > 1").select("leaf", "parts")
        dealt = spread.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.withColumn("other", other).select(
            "leaf", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), "rep", "copies", "v", "leaves", "part"
        )
        linked = dealt.groupBy("leaf", "p1", "p2").applyInArrow(compare_blocks(threshold), "a long, b long, n long, is_edge boolean")
        found = linked if found is None else found.unionByName(linked)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long, is_edge boolean")
    found = stored(spark, found, "vector_links")
    counts = found.where("not is_edge").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    parts = components(spark, found.where("is_edge").select("a", "b")).select(F.col("node").alias("rep"), "component")
    per_class = (
        classes.join(counts, "rep", "left").join(parts, "rep", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = usable.join(per_class, "v").select("id", "n_links", "component_id")
    ids = source.select("id").distinct()
    out = ids.join(linked, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
