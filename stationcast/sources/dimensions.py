"""Station and class dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.schemas import CLASSES, STATION, UNKNOWN_ZONE
from stationcast.stations import STATIONS_CSV


def stations(spark: SparkSession) -> DataFrame:
    """The default stations with their time zones."""
    rows = []
    for line in STATIONS_CSV.splitlines():
        name, slug, lat, lon, zone = line.split(",")
        rows.append((name, slug, float(lat), float(lon), zone))
    return spark.createDataFrame(rows, STATION)


def read_stations(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Stations from CSV; a missing time zone becomes UTC."""
    rows = spark.read.schema(STATION).option("header", str(header).lower()).csv(path)
    return rows.withColumn("timezone", F.coalesce("timezone", F.lit(UNKNOWN_ZONE)))


def with_timezones(stations: DataFrame, zones: DataFrame) -> DataFrame:
    """Stations with a zone from ``(slug, timezone)``; UTC where there is none."""
    joined = stations.drop("timezone").join(zones.select("slug", "timezone"), "slug", "left")
    return joined.withColumn("timezone", F.coalesce("timezone", F.lit(UNKNOWN_ZONE)))


def classes(spark: SparkSession) -> DataFrame:
    """Class, label and colour: five rows."""
    return spark.createDataFrame(CLASSES, "class int, label string, color string")
