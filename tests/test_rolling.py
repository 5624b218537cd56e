"""Medians of a moving window against the built-in median."""

import datetime as dt

from pyspark.sql import functions as F

from stationcast.operators import quantiles, rolling

UTC = dt.timezone.utc


def table(spark, n=6000):
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(100 * 86400)))
    value = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(977)) / 7)
    return spark.range(n).select(F.when(F.col("id") % 17 > 0, at).alias("timestamp"), value.alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))


def plain(rows, start, end):
    inside = rows.where((F.col("timestamp") > F.lit(start)) & (F.col("timestamp") <= F.lit(end)))
    return {c: m for c in "abc" if (m := inside.agg(F.median(F.expr(f"nanvl({c}, NULL)"))).first()[0]) is not None}


def test_steps_read_one_period_and_stay_exact(spark, tmp_path):
    rows, path = table(spark), str(tmp_path / "sketches")
    read = []
    for day in (10, 11):
        end = dt.datetime(2024, 3, day, 5, tzinfo=UTC)
        start = end - dt.timedelta(days=60)
        read.append(rolling.refresh(rows, path, ["a", "b", "c"], start, end))
        assert rolling.window_medians(rows, path, ["a", "b", "c"], start, end) == plain(rows, start, end)
    assert read == [["2024-01", "2024-02", "2024-03"], ["2024-03"]]
    assert rolling.refresh(rows, path, ["a"], start, end, changed=("2024-01",)) == ["2024-01", "2024-03"]


def test_stale_or_missing_sketches_cost_time_only(spark, tmp_path):
    rows, path = table(spark), str(tmp_path / "sketches")
    start, end = dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 2, 20, tzinfo=UTC)
    want = plain(rows, start, end)
    assert rolling.window_medians(rows, path, ["a", "b", "c"], start, end) == want
    moved = rows.withColumn("a", F.col("a") + 1000)
    rolling.refresh(moved, path, ["a"], start, end)
    assert rolling.window_medians(rows, path, ["a", "b", "c"], start, end) == want
    assert quantiles.bracketed_medians(rows.limit(0), {"a": (0.0, 1.0)}) == {}
