"""Retraining and parameter search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.operators import features, importance, metrics, quantiles, rolling, scoring, training
from stationcast.operators.series import over_series
from stationcast.schemas import FEATURES
from stationcast.session import workspace
from stationcast.sinks.tables import append_snapshot
from stationcast.sources.artifacts import save_artifacts
from stationcast.sources.tables import newest_time, read_silver


def prepare(readings: DataFrame, max_gap: str | None = None) -> DataFrame:
    """Labelled training rows, written once: medians, weights and fitting all read them."""
    spark = readings.sparkSession
    rows = training.label_rows(features.training_features(readings, max_gap=max_gap))
    path = workspace(spark, "training")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def train(
    spark: SparkSession,
    silver_path: str,
    model_dir: str,
    as_of: dt.datetime | None = None,
    lookback_days: int | None = 365,
    learner: Estimator | None = None,
    snapshots_path: str | None = None,
    sketches_path: str | None = None,
) -> DataFrame:
    """Fit on the last ``lookback_days`` (None: on all readings) and save the model with its medians (M1, M2, M8, K7, K8).

    With ``sketches_path``, quantile sketches per month are kept there and a daily run sketches the newest month only.
    Returns the transition statistics of the training rows.
    """
    as_of = as_of or newest_time(spark, silver_path)
    rows = prepare(read_silver(spark, silver_path, None if lookback_days is None else lookback_days * 24, as_of=as_of))
    if sketches_path is not None and lookback_days is not None:
        start = as_of - dt.timedelta(days=lookback_days)
        rolling.refresh(rows, sketches_path, FEATURES, start, as_of)
        medians = rolling.window_medians(rows, sketches_path, FEATURES, start - dt.timedelta(hours=1), as_of)
    else:
        medians = quantiles.median_values(rows, FEATURES)
    model = training.fit(training.impute(training.with_weights(rows), medians), learner)
    save_artifacts(spark, model, medians, model_dir)
    if snapshots_path is not None:
        nodes = importance.read_nodes(spark, f"{model_dir}/model")
        append_snapshot(importance.importances(nodes), snapshots_path, as_of.strftime("%Y-%m-%dT%H-%M"))
    return training.transition_stats(rows)


def time_folds(
    rows: DataFrame, folds: int = 3, ts: str = "timestamp", key: str = "city_slug"
) -> list[tuple[DataFrame, DataFrame]]:
    """Forward-only folds: train on everything before a cut, validate on the stretch after it.

    Cuts are quantiles of time, so the stretches are about equally large. The last row of a series before
    a cut is not trained on: its label is from after the cut.
    """
    followed = over_series(rows, key, ts, {"_next": f"lead(`{ts}`, 1)"}, 0, 1)
    shares = [i / (folds + 1) for i in range(1, folds + 1)]
    cuts = rows.agg(F.percentile_approx(ts, shares, 1000)).first()[0] + [None]
    pairs = []
    for start, end in zip(cuts[:-1], cuts[1:]):
        later = rows.where(F.col(ts) >= F.lit(start))
        known = followed.where(F.col("_next") < F.lit(start)).drop("_next")
        pairs.append((known, later if end is None else later.where(F.col(ts) < F.lit(end))))
    return pairs


def search(readings: DataFrame, learners: Mapping[str, Estimator], folds: int = 3) -> DataFrame:
    """Weighted F1 of each learner over forward-only folds, best first (M9)."""
    rows = prepare(readings)
    scores = []
    for train_rows, test_rows in time_folds(rows, folds):
        medians = quantiles.median_values(train_rows, FEATURES)
        known, unseen = training.impute(training.with_weights(train_rows), medians), training.impute(test_rows, medians)
        for name, learner in learners.items():
            made = scoring.forecaster(training.fit(known, learner))(unseen)
            scored = metrics.overall_scores(made.withColumn("actual", F.col("aqi_next"))).select("f1").first()
            scores.append((name, scored["f1"] if scored else None))
    found = readings.sparkSession.createDataFrame(scores, "learner string, f1 double")
    return found.groupBy("learner").agg(F.avg("f1").alias("f1")).orderBy(F.desc_nulls_last("f1"), "learner")


__all__ = ["prepare", "search", "time_folds", "train"]
