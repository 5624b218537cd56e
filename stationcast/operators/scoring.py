"""Forecasts from features: latest per series, back-test, history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from stationcast.functions import clamp_class, half_even
from stationcast.operators.cleaning import look_back
from stationcast.operators.features import Medians, serving_features
from stationcast.operators.series import MAX_SERIES_ROWS, Profile, latest_per_key
from stationcast.schemas import CLASSES, TARGET, UNKNOWN_COLOR, UNKNOWN_LABEL

# Takes feature rows and adds `predicted`, `confidence` and `probabilities` (class name -> share).
Forecaster = Callable[[DataFrame], DataFrame]


def persistence(rows: DataFrame) -> DataFrame:
    """The next class equals the current one."""
    predicted = clamp_class(F.col("aqi").cast("int"), 1)
    shares = F.when(
        predicted.isNotNull(),
        F.map_from_arrays(
            F.array(*[F.lit(str(c)) for c, _, _ in CLASSES]),
            F.array(*[(predicted == c).cast("double") for c, _, _ in CLASSES]),
        ),
    )
    return rows.withColumns(
        {
            "predicted": predicted,
            "confidence": F.when(predicted.isNotNull(), F.lit(1.0)),
            "probabilities": shares,
        }
    )


def forecaster(model: PipelineModel) -> Forecaster:
    """Score with a fitted model (M3, H16): first class on ties, shares rounded to 4 digits."""

    def score(rows: DataFrame) -> DataFrame:
        scored = model.transform(rows)
        if "probability" not in scored.columns:
            return _score_votes(scored)
        p = scored.withColumn("_p", vector_to_array("probability"))
        return from_shares(p).drop("inputs", "rawPrediction", "probability", "prediction", "_p")

    return score


def _score_votes(scored: DataFrame) -> DataFrame:
    """One-vs-rest gives margins only; their softmax serves as shares."""
    margins = vector_to_array("rawPrediction")
    exp = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    total = F.aggregate(exp, F.lit(0.0), lambda a, b: a + b)
    p = scored.withColumn("_p", F.transform(exp, lambda e: e / total))
    return from_shares(p).drop("inputs", "rawPrediction", "prediction", "_p")


def from_shares(rows: DataFrame) -> DataFrame:
    """Class, confidence and probabilities from the array of shares ``_p``."""
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    rounded = F.transform("_p", lambda p: half_even(p, 4))
    names = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: i.cast("string"))
    return rows.withColumns(
        {
            "predicted": best,
            "confidence": F.element_at(rounded, best),
            "probabilities": F.map_from_arrays(names, rounded),
        }
    )


def class_text(c: str | Column, field: str) -> Column:
    """Label or colour of a class, with a default for unknown ones."""
    at, default = {"label": (1, UNKNOWN_LABEL), "color": (2, UNKNOWN_COLOR)}[field]
    value = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[x for row in CLASSES for x in (F.lit(row[0]), F.lit(row[at]))])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def latest_forecast(
    readings: DataFrame,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    key: str = "city_slug",
    ts: str = "timestamp",
) -> DataFrame:
    """The next-hour forecast of every series with at least four rows (M4).

    Only the last four rows of a series reach the window.
    """
    last = latest_per_key(readings, key, ts, 4)
    features = serving_features(last, medians, key, ts, stats=Profile(0, 0, 4))
    return forecast(features).select(
        key,
        F.col(ts).alias("as_of"),
        (F.col(ts) + F.expr("INTERVAL 1 HOUR")).alias("forecast_for"),
        clamp_class(F.col("aqi").cast("int"), 1).alias("current_aqi"),
        class_text(clamp_class(F.col("aqi").cast("int"), 1), "label").alias("current_label"),
        class_text(clamp_class(F.col("aqi").cast("int"), 1), "color").alias("current_color"),
        "predicted",
        class_text("predicted", "label").alias("predicted_label"),
        class_text("predicted", "color").alias("predicted_color"),
        "confidence",
        "probabilities",
    )


def backtest(
    readings: DataFrame,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    only: str | None = None,
) -> DataFrame:
    """A forecast for every row that has three rows before it and one after.

    The time is that of the forecast row. A series of n rows gives n - 4 results; below five rows
    there are none. ``only`` names a boolean column: rows where it does not hold are read but not forecast from.
    """
    features = serving_features(readings, medians, key, ts, stats, max_rows).where(F.col("ts_next").isNotNull())
    if only is not None:
        features = features.where(F.col(only)).drop(only)
    return forecast(features).select(
        key,
        F.col("ts_next").alias(ts),
        "predicted",
        clamp_class(F.col(TARGET).cast("int"), 1).alias("actual"),
        clamp_class(F.col("aqi").cast("int"), 1).alias("current_aqi"),
    )


def history(
    readings: DataFrame,
    hours: int = 48,
    as_of: dt.datetime | None = None,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
) -> DataFrame:
    """Back-test over the last hours; four more hours are read for the look-back (M6)."""
    if not 1 <= hours <= 168:
        raise ValueError(f"hours must be within 1..168, not {hours}")
    return backtest(look_back(readings, hours + 4, ts, as_of), forecast, medians, key, ts, stats)


def last_forecasts(predictions: DataFrame, n: int = 168, key: str = "city_slug", ts: str = "timestamp") -> DataFrame:
    """The last ``n`` back-test rows of each series with their position from the end.

    The windows of 24, 48, 72 and 168 rows are ``rn <= h`` of the same table.
    """
    return latest_per_key(predictions, key, ts, n, rank="rn")
