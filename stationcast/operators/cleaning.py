"""Filters, coercion, de-duplication and unions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stationcast.functions import drop_nan, to_class, year_month
from stationcast.schemas import POLLUTANTS, READING


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select the given columns; those the table lacks become null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    Copies are dropped before the exchange as well, so a task gets at most one row per key from each
    map task, however many copies there are. ``order`` must be total for the result to be repeatable; a
    name with a leading minus is ordered downwards.
    """
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order if c not in keys]
    return _first(df, keys, by or [F.asc(keys[0])])


def newest_forecast(df: DataFrame, key: str = "city_slug") -> DataFrame:
    """One row per key and forecast hour, the one made last."""
    # Equal as_of: fall back on the remaining values, so the choice is repeatable.
    rest = [c for c in df.columns if c not in (key, "forecast_for", "as_of")]
    return _first(df, [key, "forecast_for"], [F.desc(c) for c in ("as_of", *rest)])


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def clean_readings(
    df: DataFrame,
    source: str = "pipeline",
    order: Sequence[str] = ("_file", "_row"),
) -> DataFrame:
    """Bring bulk bronze into silver form.

    Bad numbers become null, classes are rounded to whole numbers but not clamped, the first row of
    each ``(city_slug, timestamp)`` is kept, and only then rows without key or time are dropped.
    """
    names = [f.name for f in READING.fields if f.name != "source"]
    rows = align(df, [*names, *order])
    typed = rows.select(
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
        F.col("city").cast("string").alias("city"),
        F.col("city_slug").cast("string").alias("city_slug"),
        to_class("aqi").alias("aqi"),
        *[drop_nan(F.col(c).try_cast("double")).alias(c) for c in POLLUTANTS],
        F.lit(source).alias("source"),
        *order,
    )
    first = dedup_keep_first(typed, ["city_slug", "timestamp"], order).drop(*order)
    return first.dropna(subset=["timestamp", "city_slug"])


def as_of_column(df: DataFrame, ts: str, as_of: dt.datetime | None) -> Column:
    """The given moment, or the newest time in the table as a scalar subquery."""
    return F.lit(as_of) if as_of is not None else df.agg(F.max(ts)).scalar()


def look_back(df: DataFrame, hours: float, ts: str = "timestamp", as_of: dt.datetime | None = None) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``.

    A table with a ``ym`` partition column also gets the matching partition predicate, since Spark
    does not derive it from the time predicate.
    """
    start = as_of_column(df, ts, as_of) - F.make_dt_interval(hours=F.lit(int(hours)))
    rows = df.where(F.col(ts) >= start)
    return rows.where(F.col("ym") >= year_month(start)) if "ym" in df.columns else rows


def known_keys(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None) -> DataFrame:
    """Rows whose key is in the dimension."""
    return df.join(_keys(dimension, key, dimension_key), key, "left_semi")


def unknown_keys(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the dimension: the rejects of ``known_keys``."""
    return df.join(_keys(dimension, key, dimension_key), key, "left_anti")


def _keys(dimension: DataFrame, key: str, dimension_key: str | None) -> DataFrame:
    return dimension.select(F.col(dimension_key or key).alias(key)).distinct()
