"""A fitted forest as a relation, scored with column expressions.

A forest is a table with one row per node: ``tree, node, feature, threshold, left, right, gain, counts``. Leaves
have ``left = -1``; a row goes left where its value is at most the threshold, as it does for a value that is not
above it. ``counts`` are the weights of the classes among the training rows of the node, class 1 first.

To score, every tree becomes one struct of parallel arrays, indexed by node, and all trees one constant, which
Spark sends to the executors with the plan. Each row then walks each tree from the root with an array fold, and
the mean of the leaves' shares is the forecast. No join takes place, and no row carries a copy of the trees. The
constant's size is the number of nodes, which is counted first: forests beyond ``MAX_NODES`` are scored in blocks of
trees, one constant each.

A null feature goes right, as NaN does in the fitted model. A tree's nodes may come in any order and have any ids;
the root is node 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stationcast.operators.cleaning import union_all
from stationcast.operators.scoring import Forecaster, from_shares
from stationcast.schemas import CLASSES, FEATURES

# Nodes that one constant may hold: about 100 bytes each.
MAX_NODES = 50_000
_ARRAYS = "array<struct<feature: array<int>, threshold: array<double>, left: array<int>, right: array<int>, shares: array<array<double>>>>"
NODE = "tree int, node int, feature int, threshold double, left int, right int, gain double, counts array<double>"


def read_forest(spark: SparkSession, model_dir: str) -> DataFrame:
    """The nodes of a saved forest inside a saved pipeline, folder ``model`` of the artifacts."""
    saved = spark.read.parquet(f"{model_dir}/stages/*/data").select("treeID", "nodeData.*")
    return saved.select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("id").cast("int").alias("node"),
        F.col("split.featureIndex").cast("int").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").cast("int").alias("left"),
        F.col("rightChild").cast("int").alias("right"),
        F.col("gain").cast("double").alias("gain"),
        F.col("impurityStats").alias("counts"),
    )


def trees(nodes: DataFrame) -> DataFrame:
    """One row per tree: ``tree``, ``nodes`` and the struct ``t`` of parallel arrays, children as positions in them."""
    # Position of a node in its tree; ids need not be dense.
    order = Window.partitionBy("tree").orderBy("node")
    placed = nodes.withColumn("at", F.row_number().over(order) - 1)
    place = placed.select("tree", F.col("node").alias("_id"), F.col("at").alias("_at"))

    def position(rows: DataFrame, child: str) -> DataFrame:
        found = rows.join(place.withColumnsRenamed({"_id": child, "_at": f"_{child}"}), ["tree", child], "left")
        return found

    linked = position(position(placed, "left"), "right")
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    row = F.struct(
        "at",
        F.when(F.col("left") >= 0, F.col("feature")).otherwise(-1).alias("feature"),
        "threshold",
        F.col("_left").cast("int").alias("left"),
        F.col("_right").cast("int").alias("right"),
        F.when(F.col("left") < 0, F.transform("counts", lambda c: F.coalesce(F.try_divide(c, total), F.lit(0.0)))).alias("shares"),
    )
    gathered = linked.groupBy("tree").agg(F.count("*").alias("nodes"), F.sort_array(F.collect_list(row)).alias("n"))
    arrays = F.struct(*[F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "shares")])
    return gathered.select("tree", "nodes", arrays.alias("t"))


def _values(features: Sequence[str]) -> Column:
    """A row's features in order; NaN, which is above every threshold, where one is missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _next(t: Column, at: Column, x: Column) -> Column:
    """Position of the node a row goes to from position ``at``; leaves stay."""
    feature = F.get(t["feature"], at)
    left = F.get(x, feature) <= F.get(t["threshold"], at)
    return F.when(feature < 0, at).otherwise(F.when(left, F.get(t["left"], at)).otherwise(F.get(t["right"], at)))


def depth(nodes: DataFrame, limit: int = 64) -> int:
    """Edges on the longest path from a root: the children of each level are looked up until there are none."""
    level, found = nodes.where("node = 0").select("tree", "node", "left", "right"), 0
    while found < limit:
        below = level.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = nodes.select("tree", "node", "left", "right").join(below, ["tree", "node"], "left_semi")
        if level.isEmpty():
            return found
        found += 1
    raise ValueError(f"the forest is deeper than {limit} or has a loop")


def blocks(made: DataFrame, most: int = MAX_NODES) -> list[tuple[list[int], Column]]:
    """The trees in blocks of at most ``most`` nodes (a larger tree is a block of its own): their numbers and one constant."""
    sizes = made.select("tree", "nodes").orderBy("tree").collect()  # A row per tree.
    groups: list[list[int]] = []
    held = 0
    for r in sizes:
        if not groups or held + r.nodes > most:
            groups.append([])
            held = 0
        groups[-1].append(r.tree)
        held += r.nodes
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("tree", "t"))), lambda x: x["t"])
    texts = [made.where(F.col("tree").between(g[0], g[-1])).agg(F.to_json(ordered, {"ignoreNullFields": "false"})).first()[0] for g in groups]
    # Parsed once, when the plan is optimized.
    return [(g, F.from_json(F.lit(text), _ARRAYS)) for g, text in zip(groups, texts)]


def shares(
    rows: DataFrame, nodes: DataFrame, features: Sequence[str] = FEATURES, classes: int = len(CLASSES), most: int = MAX_NODES, to: str = "_p"
) -> DataFrame:
    """Add the array ``to``: the mean over all trees of the class shares in the leaf that the row reaches."""
    steps = F.sequence(F.lit(1), F.lit(max(1, depth(nodes))))
    none = F.array_repeat(F.lit(0.0), classes)
    parts = blocks(trees(nodes), most)
    if not parts:
        raise ValueError("a forest without trees")

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def leaf(t: Column) -> Column:
        at = F.aggregate(steps, F.lit(0), lambda at, _: _next(t, at, F.col("_x")))
        return F.get(t["shares"], at)

    total = none
    for _, part in parts:
        total = plus(total, F.aggregate(part, none, lambda acc, t: plus(acc, leaf(t))))
    n_trees = sum(len(numbers) for numbers, _ in parts)
    return rows.withColumn("_x", _values(features)).withColumn(to, F.transform(total, lambda v: v / n_trees)).drop("_x")


def forest_forecaster(nodes: DataFrame, features: Sequence[str] = FEATURES, most: int = MAX_NODES) -> Forecaster:
    """Score with the node table: first class on ties, shares rounded to 4 digits, as ``forecaster`` does with the model."""

    def score(rows: DataFrame) -> DataFrame:
        return from_shares(shares(rows, nodes, features, most=most)).drop("_p")

    return score


def paths(rows: DataFrame, nodes: DataFrame, features: Sequence[str] = FEATURES, most: int = MAX_NODES) -> DataFrame:
    """``tree, node, rows``: how many rows pass each node on their way to a leaf (the cover of A15 on these rows)."""
    steps = F.sequence(F.lit(1), F.lit(max(1, depth(nodes))))
    given = rows.select(_values(features).alias("_x"))

    def path(t: Column) -> Column:
        # A leaf repeats itself, so the distinct positions are the path.
        walked = F.aggregate(steps, F.array(F.lit(0)), lambda acc, _: F.concat(acc, F.array(_next(t, F.element_at(acc, -1), F.col("_x")))))
        return F.array_distinct(walked)

    counted = []
    for numbers, part in blocks(trees(nodes), most):
        each = given.select(F.posexplode(F.transform(part, path)).alias("i", "path"))
        counts = each.select("i", F.explode("path").alias("at")).groupBy("i", "at").agg(F.count("*").alias("rows"))
        tree = F.get(F.array(*[F.lit(n) for n in numbers]), F.col("i"))
        counted.append(counts.select(tree.alias("tree"), "at", "rows"))
    order = Window.partitionBy("tree").orderBy("node")
    placed = nodes.select("tree", "node", (F.row_number().over(order) - 1).alias("at"))
    found = placed.join(union_all(counted), ["tree", "at"], "left")
    return found.select("tree", "node", F.coalesce("rows", F.lit(0)).alias("rows"))


def with_cover(nodes: DataFrame, passed: DataFrame) -> DataFrame:
    """The nodes as ``importances`` reads them, the rows of ``paths`` as their cover."""
    return nodes.join(passed, ["tree", "node"]).select(
        "tree", "node", F.col("left").alias("leftChild"), F.struct(F.col("feature").alias("featureIndex")).alias("split"),
        "gain", F.col("rows").alias("rawCount"),
    )


def share_columns(column: Column, classes: int = len(CLASSES)) -> list[Column]:
    return [F.get(column, F.lit(i)).alias(f"p{i + 1}") for i in range(classes)]
