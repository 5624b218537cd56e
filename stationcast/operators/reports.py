"""Small reports over silver and gold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from stationcast.operators.cleaning import as_of_column


def rows_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per lineage value (A3)."""
    return df.groupBy(source).agg(F.count("*").alias("n"))


def latest_readings(df: DataFrame, n: int = 10, ts: str = "timestamp", tie: tuple[str, ...] = ("city_slug",)) -> DataFrame:
    """The newest rows of the table."""
    return df.orderBy(F.desc(ts), *tie).limit(n)


def freshness(
    df: DataFrame, key: str = "city_slug", ts: str = "timestamp", as_of: dt.datetime | None = None
) -> DataFrame:
    """Newest reading and its age in seconds per series."""
    now = as_of_column(df, ts, as_of)
    return df.groupBy(key).agg(F.max(ts).alias("latest")).withColumn(
        "age_seconds", F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))
    )


def forecast_counts(predictions: DataFrame, key: str = "city_slug") -> DataFrame:
    """Forecasts per series and class."""
    return predictions.groupBy(key, "predicted").agg(F.count("*").alias("n"))


def coverage(readings: DataFrame, key: str = "city_slug", need: int = 4) -> DataFrame:
    """Series with and without enough rows to forecast, and rows read."""
    per_key = readings.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count_if(F.col("n") >= need).alias("cached"),
        F.count_if(F.col("n") < need).alias("skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_fetched"),
    )
