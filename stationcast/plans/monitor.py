"""One batch that refreshes every table readers look at (K6, K9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.operators import cleaning, metrics, reports, scoring
from stationcast.operators.drift import Drift
from stationcast.operators.features import Medians
from stationcast.operators.joins import lookup
from stationcast.operators.scoring import Forecaster, persistence
from stationcast.operators.series import profile
from stationcast.schemas import HISTORY_HOURS, PREDICTION, UNKNOWN_ZONE, WARM_LOOKBACK_HOURS
from stationcast.sinks.tables import append_predictions
from stationcast.sources.dimensions import stations as default_stations
from stationcast.sources.tables import newest_time, read_silver

# Names of the two windows, by length in days.
WINDOW_NAMES = {1: ("1d", "yesterday", "today"), 7: ("7d", "prior 7 days", "last 7 days")}


def named(df: DataFrame, days: int) -> DataFrame:
    """Put the window name in front."""
    return df.select(F.lit(WINDOW_NAMES[days][0]).alias("window"), "*")


def with_labels(windows: DataFrame, days: int) -> DataFrame:
    _, before, now = WINDOW_NAMES[days]
    return windows.withColumns({"ref_label": F.lit(before), "recent_label": F.lit(now)})


def result_tables(
    readings: DataFrame,
    stations: DataFrame,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    predictions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every result table by name, from the readings of known stations."""
    stats = profile(readings, "city_slug")
    made = scoring.backtest(readings, forecast, medians, stats=stats) if predictions is None else predictions
    latest = scoring.latest_forecast(readings, forecast, medians)
    names = stations.select("slug", F.col("name").alias("city"), "timezone")
    trend = metrics.gated_trend(metrics.daily_accuracy(made), readings)
    tables = {
        "latest": lookup(latest, names, "city_slug", "slug", {"city": "—", "timezone": UNKNOWN_ZONE}),
        "history": scoring.last_forecasts(made, max(HISTORY_HOURS)),
        "trend": trend,
        "trend_summary": metrics.accuracy_summary(trend),
    }
    windows = metrics.by_window(made, newest=readings)
    tables["metrics"] = metrics.overall_scores(windows, ["window_hours"])
    tables["metrics_per_class"] = metrics.per_class_scores(windows, ["window_hours"])
    for pooled, prefix in ((False, "drift"), (True, "global_drift")):
        both = {d: Drift(readings, d, pooled, forecast, medians, stats=stats) for d in WINDOW_NAMES}
        parts = {
            "features": [named(x.features(), d) for d, x in both.items()],
            "classes": [named(x.classes(), d) for d, x in both.items()],
            "predictions": [named(x.predictions(), d) for d, x in both.items()],
            "windows": [named(with_labels(x.windows(), d), d) for d, x in both.items()],
        }
        tables |= {f"{prefix}_{name}": cleaning.union_all(frames) for name, frames in parts.items()}
    return tables


def history_documents(history: DataFrame, hours: tuple[int, ...] = HISTORY_HOURS, key: str = "city_slug") -> DataFrame:
    """One JSON text per station and window, oldest row first (H17): at most 168 rows each."""
    in_window = F.filter(F.array(*[F.lit(h) for h in hours]), lambda h: F.col("rn") <= h)
    entry = F.struct("timestamp", "predicted", "actual", "current_aqi")
    return (
        history.withColumn("hours", F.explode(in_window))
        .groupBy(key, "hours")
        .agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("document"))
    )


def warm(
    spark: SparkSession,
    silver_path: str,
    out_path: str,
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    stations: DataFrame | None = None,
    as_of: dt.datetime | None = None,
    hours: int = WARM_LOOKBACK_HOURS,
    gold_path: str | None = None,
) -> DataFrame:
    """Read the look-back once, write all tables below ``out_path``, append forecasts to gold.

    Readings and back-test are kept for the run because every table uses them. Returns one row with
    the stations covered and skipped, the rows read and the tables written.
    """
    stations = default_stations(spark) if stations is None else stations
    as_of = as_of or newest_time(spark, silver_path)
    recent = read_silver(spark, silver_path, hours, as_of=as_of)
    readings = cleaning.known_keys(recent, stations, "city_slug", "slug").persist()
    predictions = scoring.backtest(readings, forecast, medians).persist()
    try:
        tables = result_tables(readings, stations, forecast, medians, predictions)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out_path}/{name}")
        history = spark.read.parquet(f"{out_path}/history")
        history_documents(history).write.mode("overwrite").parquet(f"{out_path}/history_documents")
        if gold_path is not None:
            rows = spark.read.parquet(f"{out_path}/latest").select(*PREDICTION.fieldNames())
            append_predictions(spark, rows, gold_path)
        counts = reports.coverage(readings).first()
    finally:
        predictions.unpersist()
        readings.unpersist()
    return spark.createDataFrame(
        [(*counts, len(tables) + 1)], "cached long, skipped long, rows_fetched long, tables_written int"
    )
