"""Fitted model, feature list and medians."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from stationcast.schemas import FEATURES


def save_artifacts(spark: SparkSession, model: PipelineModel, medians: Mapping[str, float], path: str) -> None:
    """Write the model, the feature order and the medians below one folder."""
    model.write().overwrite().save(f"{path}/model")
    for name, value in (("medians", dict(medians)), ("features", FEATURES)):
        text = spark.createDataFrame([(json.dumps(value),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load_artifacts(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, float]]:
    """The model and its medians, one number per feature."""
    medians, features = (json.loads(spark.read.text(f"{path}/{name}").first()[0]) for name in ("medians", "features"))
    if features != FEATURES:
        raise ValueError(f"{path} was fitted on other features")
    return PipelineModel.load(f"{path}/model"), medians
