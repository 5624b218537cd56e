"""Readers for bronze, silver and gold."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stationcast.functions import drop_nan, path_value
from stationcast.operators.cleaning import look_back, union_all
from stationcast.operators.features import readable
from stationcast.schemas import BRONZE_BULK, BRONZE_HOURLY, GOLD, POLLUTANTS, SILVER


def with_position(df: DataFrame) -> DataFrame:
    """File and row a record came from: a repeatable order for keep-first."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _unescaped(value: Column) -> Column:
    """The value a folder stands for, null where it has none: escaped by its writer and again in the URI of a file."""
    decoded = value
    for _ in range(2):
        # A plus sign stands for itself in paths.
        decoded = F.coalesce(F.try_url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B"))), decoded)
    plain = F.when((value != "") & (value != "__HIVE_DEFAULT_PARTITION__"), value)
    return F.when(value.contains("%"), decoded).otherwise(plain)


def with_folders(df: DataFrame, names: Sequence[str], file: str = "_file") -> DataFrame:
    """Columns of the last ``name=value`` folders of a path, as text; null in files that are not in such folders.

    Each step is a projection of its own, so that a path is taken apart once a row.
    """
    parts, tail = [f"_folder_{n}" for n in names], F.substring_index(file, "/", -1 - len(names))
    df = df.withColumn("_folders", tail)
    df = df.withColumns({p: F.split_part("_folders", F.lit("/"), F.lit(i)) for i, p in enumerate(parts, 1)})
    inside = F.lit(True)
    for p, n in zip(parts, names):
        inside = inside & F.startswith(p, F.lit(f"{n}="))
    df = df.withColumns({p: F.when(inside, F.substr(p, F.lit(len(n) + 2))) for p, n in zip(parts, names)})
    return df.withColumns({n: _unescaped(F.col(p)) for n, p in zip(names, parts)}).drop("_folders")


def read_bulk(spark: SparkSession, root: str, named_folders: bool = True) -> DataFrame:
    """Bulk bronze (S1). Folders are ``city_slug=/year=/month=``, or of any depth and naming.

    Station, year and month are read off each file's path. Spark's own discovery of partitions does this in the
    driver, in time that grows with the square of the folders. Files outside such folders keep the station they
    hold and have no year and month.
    """
    rows = with_position(spark.read.schema(BRONZE_BULK).option("recursiveFileLookup", "true").parquet(root))
    if not named_folders:
        return rows
    found = with_folders(rows.withColumnRenamed("city_slug", "_held"), ["city_slug", "year", "month"])
    slug = F.when(F.col("_folder_city_slug").isNull(), F.col("_held")).otherwise(F.col("city_slug"))
    return found.withColumn("city_slug", slug).select(*BRONZE_BULK.fieldNames(), "year", "month", "_file", "_row")


def read_mixed_bulk(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Bulk bronze whose folders disagree on types: each is read with its own types, all as text.

    One scan has one schema, so files that store a column differently cannot share it. Cleaning turns
    the text back into numbers.
    """
    frames = []
    for root in roots:
        part = with_position(spark.read.option("recursiveFileLookup", "true").parquet(root))
        frames.append(part.select(*[F.col(c) if c == "_row" else F.col(c).cast("string").alias(c) for c in part.columns]))
    return union_all(frames)


def read_hourly(spark: SparkSession, root: str, year: str | None = None, month: str | None = None) -> DataFrame:
    """Hourly bronze in ``year=/month=/day=`` folders, values as zero-padded text."""
    rows = with_position(spark.read.schema(BRONZE_HOURLY).parquet(root))
    for name, value in (("year", year), ("month", month)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def only_file(df: DataFrame, path: str) -> DataFrame:
    """Rows of exactly one file; other files are not opened (S3)."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return df.where(bare(F.col("_metadata.file_path")) == bare(F.lit(path)))


def partition_of(path: str | Column) -> list[Column]:
    """Year, month and day from a file path."""
    return [path_value(path, name).alias(name) for name in ("year", "month", "day")]


def read_silver(
    spark: SparkSession,
    path: str,
    hours: float | None = None,
    keys: Sequence[str] | None = None,
    as_of: dt.datetime | None = None,
    clamp: bool = True,
) -> DataFrame:
    """Silver over a look-back, for one, some or all stations.

    The look-back ends at ``as_of``, by default the newest time in the table. The class is cut at 5 on
    reading only; the table keeps what was delivered.
    """
    rows = spark.read.schema(SILVER).parquet(path)
    if hours is not None:
        rows = look_back(rows, hours, "timestamp", as_of or newest_time(spark, path))
    if keys is not None:
        rows = rows.where(F.col("city_slug").isin(list(keys)))
    rows = rows.withColumns({c: drop_nan(c) for c in POLLUTANTS})
    return readable(rows) if clamp else rows


def newest_time(spark: SparkSession, path: str) -> dt.datetime:
    """The newest time in silver: months come from the file listing, only the newest one is read."""
    rows = spark.read.schema(SILVER).parquet(path)
    found = (re.search(r"/ym=(\d{4}-\d{2})/", f) for f in rows.inputFiles())
    months = [m[1] for m in found if m]
    if not months:
        raise ValueError(f"{path} holds no readings")
    return rows.where(F.col("ym") == max(months)).agg(F.max("timestamp")).first()[0]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Gold forecasts."""
    return spark.read.schema(GOLD).parquet(path)
