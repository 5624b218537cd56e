"""Bronze to silver in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from stationcast.operators.cleaning import clean_readings
from stationcast.operators.joins import weather_with_air
from stationcast.operators.reports import rows_by_source
from stationcast.operators.upsert import upsert_table
from stationcast.schemas import SILVER
from stationcast.sinks.tables import seed_silver, write_bulk
from stationcast.sources.responses import read_air, read_weather
from stationcast.sources.tables import only_file, read_bulk, read_hourly, read_mixed_bulk
from stationcast.operators.cleaning import dedup_keep_first
from stationcast.streaming.ingest import as_reading


def land_responses(spark: SparkSession, air_path: str, weather_path: str | None, bronze_path: str) -> None:
    """API responses to bulk bronze: flatten, de-duplicate, join weather where there is any."""
    keys = ["city_slug", "dt"]

    def first(df: DataFrame) -> DataFrame:
        return dedup_keep_first(df, keys, df.columns)

    air = first(read_air(spark, air_path))
    rows = air if weather_path is None else weather_with_air(first(read_weather(spark, weather_path)), air)
    write_bulk(rows, bronze_path)


def backfill(
    spark: SparkSession, bronze: str | Sequence[str], silver_path: str, named_folders: bool = True
) -> DataFrame:
    """Clean bulk bronze and fill silver; returns rows per source as a check.

    Several folders may disagree on column types.
    """
    if isinstance(bronze, str):
        rows = read_bulk(spark, bronze, named_folders)
    else:
        rows = read_mixed_bulk(spark, bronze)
    seed_silver(spark, clean_readings(rows), silver_path)
    return rows_by_source(spark.read.schema(SILVER).parquet(silver_path))


def merge_file(spark: SparkSession, hourly_root: str, file: str, silver_path: str, source: str = "hourly") -> None:
    """Upsert exactly one hourly file into silver (S3, K4)."""
    rows = only_file(read_hourly(spark, hourly_root), file)
    upsert_table(spark, silver_path, as_reading(rows, source), SILVER)
