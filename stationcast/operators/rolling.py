"""Medians of a moving window from sketches that are kept per period (A1 with M8)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.operators import quantiles

SKETCHES = "feature string, n long, sketch binary, period string"
# A quantile sketch of this size is off by less than 1 % of the ranks; the bracket takes twice that on each side.
SKETCH_SIZE = 400
BRACKET = (0.48, 0.52)
_FORMATS = {"day": "%Y-%m-%d", "month": "%Y-%m"}
_PATTERNS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def period_sketches(rows: DataFrame, columns: list[str], unit: str = "month", ts: str = "timestamp") -> DataFrame:
    """One mergeable quantile sketch per period and column; nulls, NaN and rows without a time take no part."""
    values = ", ".join(f"struct('{c}' AS feature, {quantiles.as_number(c)} AS value)" for c in columns)
    long = rows.where(F.col(ts).isNotNull()).select(F.date_format(ts, _PATTERNS[unit]).alias("period"), F.expr(f"inline(array({values}))"))
    found = long.where("value IS NOT NULL").groupBy("period", "feature")
    return found.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", SKETCH_SIZE).alias("sketch")).select("feature", "n", "sketch", "period")


def periods_of(start: dt.datetime, end: dt.datetime, unit: str) -> list[str]:
    """Names of all periods that the stretch from start to end touches, in order."""
    days = (end.date() - start.date()).days
    return sorted({(start.date() + dt.timedelta(days=i)).strftime(_FORMATS[unit]) for i in range(days + 1)})


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SKETCHES).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SKETCHES)
        raise


def refresh(
    rows: DataFrame, path: str, columns: list[str], start: dt.datetime, end: dt.datetime,
    unit: str = "month", ts: str = "timestamp", changed: tuple[str, ...] = (),
) -> list[str]:
    """Bring the sketches of a window up to date and return the periods that were read for it.

    Read are the periods without sketches, the newest one, which is still filling up, and those in ``changed``
    (late readings). Each is replaced as a whole, so a step that runs again changes nothing. ``rows`` has to
    hold whole periods but for the edges of the window.
    """
    wanted = periods_of(start, end, unit)
    known = {r.period for r in read_sketches(rows.sparkSession, path).select("period").distinct().collect()}
    todo = [p for p in wanted if p not in known or p == wanted[-1] or p in changed]
    fresh = rows.where(F.date_format(ts, _PATTERNS[unit]).isin(todo)).where(F.col(ts).between(_start_of(todo[0], unit), end))
    sketches = period_sketches(fresh, columns, unit, ts)
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    return todo


def _start_of(period: str, unit: str) -> F.Column:
    """The bound on time itself, which reaches the scan; the period's name does not."""
    return F.lit(period if unit == "day" else f"{period}-01").cast("timestamp")


def window_medians(
    rows: DataFrame, path: str, columns: list[str], start: dt.datetime, end: dt.datetime, unit: str = "month", ts: str = "timestamp"
) -> dict[str, float]:
    """Exact medians of the rows after ``start`` and up to ``end``.

    Merged sketches of the periods in the window say where the middle has to be looked for; counting the
    window's rows around that bracket decides. Sketches that are out of date, or that cover more than the window
    at its edges, cost time only. A column without sketches is bracketed from the rows.
    """
    spark = rows.sparkSession
    window = rows.where((F.col(ts) > F.lit(start)) & (F.col(ts) <= F.lit(end)))
    stored = read_sketches(spark, path).where(F.col("period").isin(periods_of(start, end, unit)) & F.col("feature").isin(columns))
    merged = stored.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    ends = merged.select("feature", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for q, n in zip(BRACKET, ("low", "high"))])
    brackets = {r.feature: (r.low, r.high) for r in ends.collect()}
    others = [c for c in columns if c not in brackets]
    return {
        **quantiles.bracketed_medians(window, {c: brackets[c] for c in columns if c in brackets}),
        **(quantiles.median_values(window, others) if others else {}),
    }
