"""Landed API responses and prediction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stationcast.functions import dew_point, half_even, iso_seconds
from stationcast.schemas import AIR_RESPONSE, POLLUTANTS, PREDICTION, PREDICTION_LINE, WEATHER_RESPONSE


def read_air(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Air responses, one JSON document per line (or per file with ``multi_line``)."""
    return flatten_air(spark.read.schema(AIR_RESPONSE).option("multiLine", str(multi_line).lower()).json(path))


def read_weather(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return flatten_weather(spark.read.schema(WEATHER_RESPONSE).option("multiLine", str(multi_line).lower()).json(path))


def parse_responses(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """Responses held as text, one per row, for the flatten functions.

    A generator, so that filters and projections cannot be pushed past it and parse a line again.
    """
    return lines.select(F.inline_outer(F.array(F.from_json(column, schema))))


def _records(responses: DataFrame) -> DataFrame:
    keep = [c for c in responses.columns if c != "list"]
    return responses.select(*keep, F.explode("list").alias("r"))


def _station(responses: DataFrame) -> list[str]:
    return [c for c in ("city", "city_slug") if c in responses.columns]


def flatten_air(responses: DataFrame) -> DataFrame:
    """One row per record: time, class, eight pollutants; absent values are null."""
    return _records(responses).select(
        *_station(responses),
        F.col("r.dt").alias("dt"),
        F.timestamp_seconds("r.dt").alias("timestamp"),
        F.col("r.main.aqi").alias("aqi"),
        *[F.col(f"r.components.{c}").alias(c) for c in POLLUTANTS],
    )


def flatten_weather(responses: DataFrame) -> DataFrame:
    """One row per record; the first weather entry counts, missing rain and snow are 0."""
    first = F.get("r.weather", F.lit(0))

    def r(path, name):
        return F.col(f"r.{path}").alias(name)

    return _records(responses).select(
        *_station(responses),
        r("dt", "dt"),
        F.timestamp_seconds("r.dt").alias("timestamp"),
        r("main.temp", "temp_c"),
        r("main.feels_like", "feels_like_c"),
        r("main.temp_min", "temp_min_c"),
        r("main.temp_max", "temp_max_c"),
        r("main.pressure", "pressure_hpa"),
        r("main.sea_level", "sea_level_hpa"),
        r("main.grnd_level", "grnd_level_hpa"),
        r("main.humidity", "humidity_pct"),
        dew_point("r.main.temp", "r.main.humidity").alias("dew_point_c"),
        r("wind.speed", "wind_speed_ms"),
        r("wind.deg", "wind_deg"),
        r("wind.gust", "wind_gust_ms"),
        r("clouds.all", "clouds_pct"),
        r("visibility", "visibility_m"),
        F.coalesce("r.rain.`1h`", F.lit(0.0)).alias("rain_1h_mm"),
        F.coalesce("r.snow.`1h`", F.lit(0.0)).alias("snow_1h_mm"),
        first["id"].alias("weather_id"),
        first["main"].alias("weather_main"),
        first["description"].alias("weather_desc"),
    )


def parse_predictions(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split prediction lines into gold rows and rejects.

    A line is rejected when it is not JSON, lacks a field, or holds a time that cannot be read.
    """
    parse = F.from_json(
        column, PREDICTION_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    # A generator, so that the filters below cannot be pushed past it and parse each line again.
    parsed = lines.select(F.col(column).alias("line"), F.inline_outer(F.array(parse)))
    rows = parsed.select(
        "line",
        iso_seconds("forecast_for").alias("forecast_for"),
        "city_slug",
        "predicted",
        half_even("confidence", 6).alias("confidence"),
        iso_seconds("as_of").alias("as_of"),
    )
    complete = F.lit(True)
    for f in PREDICTION.fieldNames():
        complete = complete & F.col(f).isNotNull()
    return rows.where(complete).drop("line"), rows.where(~complete).select("line")
