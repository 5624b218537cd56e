"""Training rows: transitions, weights, imputation, fitting."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from stationcast.operators.features import Medians, median_of
from stationcast.schemas import FEATURES, SINGLE_HOP_BOOST, TARGET, TRANSITION_BOOST


def transition_kind(aqi: str = "aqi", following: str = TARGET, after: str = "aqi_next2") -> Column:
    """``steady``, ``sustained`` (the new class holds for another row) or ``single_hop``.

    A missing current class differs from any following one. Without a second following row the first
    stands in for it, so the change counts as sustained.
    """
    changed = ~F.col(aqi).eqNullSafe(F.col(following))
    holds = F.col(following) == F.coalesce(F.col(after), F.col(following))
    return F.when(~changed, "steady").when(holds, "sustained").otherwise("single_hop")


def label_rows(features: DataFrame) -> DataFrame:
    """Add the 0-based label and the transition kind."""
    return features.withColumn("label", (F.col(TARGET) - 1).cast("double")).withColumn("kind", transition_kind())


def weight_table(rows: DataFrame, boost: float = TRANSITION_BOOST, hop_boost: float = SINGLE_HOP_BOOST) -> DataFrame:
    """``(label, kind, n, weight)``: balanced class weight times boost, mean 1 over all rows (A4, A5).

    The weight depends on label and kind only, so one count per combination is enough: at most 15 for
    five classes.
    """
    counted = rows.groupBy("label", "kind").agg(F.count("*").alias("n")).collect()
    total = sum(c.n for c in counted)
    sizes = {label: sum(c.n for c in counted if c.label == label) for label in {c.label for c in counted}}
    factor = {"sustained": boost, "single_hop": hop_boost}
    raw = {c: factor.get(c.kind, 1.0) * total / (len(sizes) * sizes[c.label]) for c in counted}
    mean = sum(w * c.n for c, w in raw.items()) / total if total else 1.0
    table = [(c.label, c.kind, c.n, w / mean) for c, w in raw.items()]
    return rows.sparkSession.createDataFrame(table, "label double, kind string, n long, weight double")


def with_weights(rows: DataFrame, **boosts: float) -> DataFrame:
    """Attach the sample weight to labelled rows. The weight table has at most 15 rows."""
    table = weight_table(rows, **boosts).drop("n")
    return rows.join(F.broadcast(table), ["label", "kind"])


def transition_stats(rows: DataFrame) -> DataFrame:
    """Row count, transitions and their share, sustained and single-hop."""
    changed = F.col("kind") != "steady"
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(changed).alias("transitions"),
        F.avg(changed.cast("double")).alias("share"),
        F.count_if(F.col("kind") == "sustained").alias("sustained"),
        F.count_if(F.col("kind") == "single_hop").alias("single_hop"),
    )


def class_distribution(rows: DataFrame, column: str = TARGET) -> DataFrame:
    """Rows and percentage per class (A2)."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / counts.agg(F.sum("n")).scalar())


def load_stats(df: DataFrame, key: str = "city_slug", aqi: str = "aqi", highest: int = 5) -> DataFrame:
    """Rows, series and out-of-range classes, counted before clamping."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(aqi) > highest).alias("over"))
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(key).alias("series"), F.sum("over").alias("out_of_range")
    )


def impute(df: DataFrame, medians: Medians, columns: list[str] = FEATURES) -> DataFrame:
    """Fill missing features with their medians."""
    filled = "coalesce(nanvl(CAST(`{0}` AS DOUBLE), NULL), {1!r}D)"
    return df.withColumns({c: F.expr(filled.format(c, median_of(medians, c))) for c in columns})


def random_forest(trees: int = 40, depth: int = 6, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="inputs", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )


def boosted_trees(rounds: int = 20, depth: int = 6, step: float = 0.1, seed: int = 42) -> OneVsRest:
    """One boosted model per class: the learner itself is binary."""
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return OneVsRest(classifier=one, featuresCol="inputs", labelCol="label", weightCol="weight")


def logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="inputs", labelCol="label", weightCol="weight", family="multinomial")


def fit(rows: DataFrame, learner=None, columns: list[str] = FEATURES) -> PipelineModel:
    """Assemble the features in order and fit a weighted classifier (M1, M2)."""
    assembler = VectorAssembler(inputCols=columns, outputCol="inputs", handleInvalid="error")
    return Pipeline(stages=[assembler, learner or random_forest()]).fit(rows)
