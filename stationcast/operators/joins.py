"""Joins between tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from stationcast.operators.cleaning import newest_forecast


def predicted_vs_actual(predictions: DataFrame, readings: DataFrame, key: str = "city_slug") -> DataFrame:
    """Forecasts with the class read at exactly the forecast hour.

    Repeated forecasts for one hour count once, the newest. This joins on the exact time; the
    back-test takes the next row instead, so the two differ where hours are missing.
    """
    truth = readings.select(key, F.col("timestamp").alias("forecast_for"), F.col("aqi").alias("actual"))
    return (
        newest_forecast(predictions, key)
        .join(truth, [key, "forecast_for"])
        .select(key, "forecast_for", "predicted", "confidence", "actual")
    )


def weather_with_air(weather: DataFrame, air: DataFrame, station: str = "city_slug", time: str = "dt") -> DataFrame:
    """Weather rows with the air readings of the same moment.

    Both sides must hold one row per station and moment. Columns both have, such as the timestamp,
    come from the weather side. Stations without any weather keep their air rows; stations without
    air readings keep their weather rows.
    """
    shared = [c for c in air.columns if c in weather.columns and c not in (station, time)]
    both = weather.join(air.drop(*shared), [station, time], "left")
    air_only = air.join(weather.select(station).distinct(), station, "left_anti")
    return both.unionByName(air_only, allowMissingColumns=True)


def lookup(
    df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, defaults: Mapping[str, str]
) -> DataFrame:
    """Add dimension columns, with a default where the key is unknown.

    The join strategy is left to the optimizer, which broadcasts a dimension below its size threshold.
    """
    side = dimension.select(F.col(dimension_key).alias(key), *defaults)
    joined = df.join(side, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
