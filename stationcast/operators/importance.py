"""Feature importances from the trees of a saved forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.functions import half_even
from stationcast.schemas import FEATURES

_KINDS = ("weight", "gain", "cover")


def read_nodes(spark: SparkSession, model_dir: str) -> DataFrame:
    """The node table a saved tree ensemble keeps in its ``data`` folder, inside a saved pipeline."""
    return spark.read.parquet(f"{model_dir}/stages/*/data").select("nodeData.*")


def importances(nodes: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """``feature, weight, gain, cover``, each scaled to sum 1 and rounded to 4 digits.

    weight: number of splits; gain: mean gain of a split; cover: mean rows at a split. Features
    without a split are absent.
    """
    splits = nodes.where(F.col("leftChild") >= 0)
    per_feature = splits.groupBy(F.col("split.featureIndex").alias("i")).agg(
        F.count("*").cast("double").alias("weight"),
        F.avg("gain").alias("gain"),
        F.avg("rawCount").alias("cover"),
    )
    totals = per_feature.agg(F.struct(*[F.sum(k).alias(k) for k in _KINDS])).scalar()
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return per_feature.select(
        name.alias("feature"), *[half_even(F.try_divide(F.col(k), totals[k]), 4).alias(k) for k in _KINDS]
    )
