"""Table schemas and the fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

POLLUTANTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]

_POLLUTANT_FIELDS = [T.StructField(c, T.DoubleType()) for c in POLLUTANTS]

BRONZE_BULK = T.StructType(
    [
        T.StructField("dt", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("aqi", T.DoubleType()),
        *_POLLUTANT_FIELDS,
        T.StructField("city", T.StringType()),
        T.StructField("city_slug", T.StringType()),
    ]
)

BRONZE_HOURLY = T.StructType(
    [
        T.StructField("dt", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("city", T.StringType()),
        T.StructField("city_slug", T.StringType()),
        T.StructField("aqi", T.IntegerType()),
        *_POLLUTANT_FIELDS,
        T.StructField("year", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("day", T.StringType()),
    ]
)

READING = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("city", T.StringType()),
        T.StructField("city_slug", T.StringType()),
        T.StructField("aqi", T.IntegerType()),
        *_POLLUTANT_FIELDS,
        T.StructField("source", T.StringType()),
    ]
)
SILVER = T.StructType([*READING.fields, T.StructField("ym", T.StringType())])

PREDICTION = T.StructType(
    [
        T.StructField("forecast_for", T.TimestampType()),
        T.StructField("city_slug", T.StringType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("as_of", T.TimestampType()),
    ]
)
GOLD = T.StructType([*PREDICTION.fields, T.StructField("ym", T.StringType())])

PREDICTION_LINE = T.StructType(
    [
        T.StructField("city_slug", T.StringType()),
        T.StructField("as_of", T.StringType()),
        T.StructField("forecast_for", T.StringType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

STATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("timezone", T.StringType()),
    ]
)

AIR_RECORD = T.StructType(
    [
        T.StructField("dt", T.LongType()),
        T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
        T.StructField("components", T.StructType(_POLLUTANT_FIELDS)),
    ]
)
AIR_RESPONSE = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("city_slug", T.StringType()),
        T.StructField("list", T.ArrayType(AIR_RECORD)),
    ]
)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


WEATHER_RECORD = T.StructType(
    [
        T.StructField("dt", T.LongType()),
        T.StructField(
            "main",
            _doubles(
                "temp", "feels_like", "temp_min", "temp_max",
                "pressure", "sea_level", "grnd_level", "humidity",
            ),
        ),
        T.StructField("wind", _doubles("speed", "deg", "gust")),
        T.StructField("clouds", _doubles("all")),
        T.StructField("visibility", T.DoubleType()),
        T.StructField("rain", _doubles("1h")),
        T.StructField("snow", _doubles("1h")),
        T.StructField(
            "weather",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("main", T.StringType()),
                        T.StructField("description", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
WEATHER_RESPONSE = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("city_slug", T.StringType()),
        T.StructField("list", T.ArrayType(WEATHER_RECORD)),
    ]
)

# ---------------------------------------------------------------------------
# These must stay as they are for results to match.
# ---------------------------------------------------------------------------

# Model inputs, in the order the vector is assembled.
FEATURES = [
    "pm10_lag1",
    "aqi_delta_1h",
    "pm10_delta_1h",
    "aqi_delta_2h",
    "aqi_delta_3h",
    "aqi_roll_std4",
    "pm25_delta_1h",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
    "pm25_ratio",
    "co",
    "no",
    "no2",
    "o3",
    "so2",
    "nh3",
    "pm10",
]
TARGET = "aqi_next"

# Inputs watched for drift; deltas and cyclic encodings cannot drift and are left out.
DRIFT_FEATURES = [
    "pm10_lag1", "pm25_ratio", "aqi_roll_std4",
    "co", "no", "no2", "o3", "so2", "nh3", "pm10",
]

# Class, label, display colour.
CLASSES = [
    (1, "Good", "#50f0e6"),
    (2, "Fair", "#50ccaa"),
    (3, "Moderate", "#f0e641"),
    (4, "Poor", "#ff5050"),
    (5, "Very Poor", "#960032"),
]
UNKNOWN_LABEL, UNKNOWN_COLOR, UNKNOWN_ZONE = "—", "#ccc", "UTC"

# Medians used for missing inputs when no fitted medians are supplied.
DEFAULT_MEDIANS = {
    "pm10_lag1": 14.68,
    "aqi_delta_1h": 0.0,
    "pm10_delta_1h": 0.05,
    "aqi_delta_2h": 0.0,
    "aqi_delta_3h": 0.0,
    "aqi_roll_std4": 0.0,
    "pm25_delta_1h": 0.03,
    "hour_sin": 0.0,
    "hour_cos": 0.0,
    "month_sin": 0.0,
    "month_cos": 0.0,
    "pm25_ratio": 0.1049,
    "co": 156.15,
    "no": 0.01,
    "no2": 2.71,
    "o3": 57.55,
    "so2": 1.48,
    "nh3": 0.58,
    "pm10": 14.68,
}

TRANSITION_BOOST, SINGLE_HOP_BOOST = 5.0, 2.0
RATIO_EPSILON = 1e-9
HISTORY_HOURS = (24, 48, 72, 168)
WARM_LOOKBACK_HOURS = 340
