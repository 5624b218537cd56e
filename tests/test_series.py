"""Cut series must give what the plain window gives."""

import bisect
import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stationcast.operators import drift, features, scoring, series


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(spark):
    """A third of all rows in one series, at very uneven times."""
    ids = spark.range(3000)
    hot = F.col("id") % 3 == 0
    second = F.when(F.col("id") < 1500, F.col("id")).otherwise(F.col("id") * 50_000)
    return ids.select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 90)).alias("city_slug"),
        F.timestamp_seconds(second).alias("timestamp"),
        (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int").alias("aqi"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("pm10"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 20).alias("pm2_5"),
        *[F.lit(1.0).alias(c) for c in ("co", "no", "no2", "o3", "so2", "nh3")],
    )


def test_cut_series_equal_whole_series(spark):
    df = skewed(spark).cache()
    for build in (features.training_features, features.serving_features, features.drift_features, scoring.backtest):
        assert rows_of(build(df, max_rows=100)) == rows_of(build(df)), build.__name__


def test_drift_over_cut_series(spark):
    df = skewed(spark).cache()
    for pooled in (False, True):
        cut, whole = (drift.Drift(df, 30, pooled, max_rows=n) for n in (50, 5_000_000))
        for part in ("features", "predictions"):
            assert rows_of(getattr(cut, part)()) == rows_of(getattr(whole, part)()), (pooled, part)


def test_only_long_series_are_cut_and_pieces_fit(spark):
    df = skewed(spark)
    stats = series.profile(df, "city_slug")
    assert (stats.rows, stats.longest) == (3000, 1000)
    cuts = series.long_series(df, "city_slug", "timestamp", 100).collect()
    assert [r.city_slug for r in cuts] == ["hot"]
    assert fullest_piece(df.where("city_slug = 'hot'"), cuts[0]._bounds) <= 100


def fullest_piece(rows, bounds):
    at = sorted(r[0] for r in rows.select("timestamp").collect())
    sizes = [0] * (len(bounds) + 1)
    for t in at:
        sizes[bisect.bisect_right(bounds, t)] += 1
    return max(sizes)


def test_pieces_of_a_burst_fit_and_few_rows_are_borders(spark):
    """20,000 rows a minute apart and 2,000 within a second: many bounds, more than one stride of heads."""
    ids = spark.range(22_000)
    at = F.when(F.col("id") < 20_000, F.col("id") * 60_000_000).otherwise(F.col("id") * 400 + F.lit(30_000_000_000))
    df = ids.select(F.lit("x").alias("city_slug"), F.timestamp_micros(at).alias("timestamp"), "id").cache()
    for limit in (60, 1000):
        cuts = series.long_series(df, "city_slug", "timestamp", limit).first()
        assert fullest_piece(df, cuts._bounds) <= limit
        assert len(cuts._bounds) <= 3 * 22_000 / limit
        columns = {"l1": "lag(id, 1)", "n2": "lead(id, 2)"}
        cut = series.over_series(df, "city_slug", "timestamp", columns, 1, 2, max_rows=limit)
        whole = series.over_series(df, "city_slug", "timestamp", columns, 1, 2)
        assert cut.exceptAll(whole).isEmpty() and cut.count() == 22_000


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(0, 400_000)), min_size=1, max_size=40, unique=True
    )
)
def test_any_times(spark, rows):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(k, None if m is None else start + dt.timedelta(minutes=m), m) for k, m in rows], "k string, t timestamp, v int")
    columns = {"l1": "lag(v, 1)", "l3": "lag(v, 3)", "n2": "lead(v, 2)"}
    cut = series.over_series(df, "k", "t", columns, 3, 2, max_rows=2)
    assert rows_of(cut) == rows_of(series.over_series(df, "k", "t", columns, 3, 2))


def test_salted_join_equals_plain_join(spark, monkeypatch):
    df = skewed(spark)
    newest = df.groupBy("city_slug").agg(F.max("timestamp").alias("last"))
    plain = rows_of(series.with_key_values(df, newest, "city_slug"))
    monkeypatch.setattr(series, "MAX_BROADCAST_ROWS", 5)
    for by in (None, "timestamp"):
        assert rows_of(series.with_key_values(df, newest, "city_slug", spread_by=by, salts=4)) == plain


def test_latest_rows_are_limited_before_the_exchange(spark):
    df = series.latest_per_key(skewed(spark), "city_slug", "timestamp", 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.groupBy("city_slug").count().agg(F.max("count")).first()[0] == 4
