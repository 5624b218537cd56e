"""The test tables seen as station readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stationcast.operators.features import readable
from stationcast.schemas import POLLUTANTS
from stationcast.streaming.ingest import DELIVERY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_readings(events: DataFrame) -> DataFrame:
    """One series per user; classes 1-6, some pollutants missing."""
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "concat('User ', user_id) AS city",
        "concat('user-', user_id) AS city_slug",
        "CAST(1 + k % 6 AS INT) AS aqi",
        "CASE WHEN k % 17 <> 0 THEN 100D + 3D * k END AS co",
        "0.5D * (k % 7) AS no",
        "CASE WHEN k % 10 <> 0 THEN value * 0.25D END AS no2",
        "1D + k AS o3",
        "value * 0.125D AS so2",
        "CASE WHEN event_type <> 'error' THEN value * 0.5D END AS pm2_5",
        "value AS pm10",
        "CASE WHEN event_type <> 'view' THEN value * 0.0625D END AS nh3",
        "CASE WHEN event_type = 'click' THEN 'hourly' ELSE 'pipeline' END AS source",
        *[c for c in DELIVERY if c in events.columns],
    )


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as stored: class 6 not yet cut."""
    return events_as_readings(table(spark, sf_dir, "events"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(silver(spark, sf_dir))


READINGS_SQL = """
raw AS (
  SELECT ts AS "timestamp", 'User ' || user_id AS city, 'user-' || user_id AS city_slug,
         CAST(1 + k % 6 AS INTEGER) AS aqi_raw, CAST(least(1 + k % 6, 5) AS INTEGER) AS aqi,
         CASE WHEN k % 17 <> 0 THEN 100.0::DOUBLE + 3.0::DOUBLE * k END AS co,
         0.5::DOUBLE * (k % 7) AS no,
         CASE WHEN k % 10 <> 0 THEN value * 0.25::DOUBLE END AS no2,
         1.0::DOUBLE + k AS o3,
         value * 0.125::DOUBLE AS so2,
         CASE WHEN event_type <> 'error' THEN value * 0.5::DOUBLE END AS pm2_5,
         value AS pm10,
         CASE WHEN event_type <> 'view' THEN value * 0.0625::DOUBLE END AS nh3,
         CASE WHEN event_type = 'click' THEN 'hourly' ELSE 'pipeline' END AS source,
         event_id, event_type, value, user_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def for_compare(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zero."""
    double = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.selectExpr(*[f"round(`{c}`, {digits}) + 0D AS `{c}`" if c in double else f"`{c}`" for c in df.columns])


def sql_round(*columns: str, digits: int = 6) -> str:
    """The same for a SQL select list."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


__all__ = ["POLLUTANTS", "READINGS_SQL", "events_as_readings", "for_compare", "readings", "silver", "sql_round", "table"]
