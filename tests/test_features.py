"""Golden values for features, labels and weights."""

from collections import Counter

import pytest
from conftest import reading
from pyspark.sql import functions as F

from stationcast.functions import dew_point, to_class
from stationcast.operators import features, quantiles, training
from stationcast.schemas import FEATURES


def counts(df, column):
    return Counter(r[0] for r in df.select(column).collect())


@pytest.mark.parametrize("series,hours", [(2, 24), (2, 20), (3, 15)])
def test_each_series_loses_four_rows(training_frame, series, hours):
    assert features.training_features(training_frame(series, hours)).count() == series * (hours - 4)


def test_training_values(training_frame):
    rows = features.training_features(training_frame()).cache()
    assert counts(rows, "pm25_ratio") == {0.0909: 40}
    assert counts(rows, "aqi_delta_1h") == {1.0: 32, -4.0: 8}
    assert counts(rows, "aqi_delta_2h") == {2.0: 24, -3.0: 16}
    assert counts(rows, "aqi_delta_3h") == {-2.0: 24, 3.0: 16}
    assert counts(rows, "aqi_roll_std4") == {1.291: 16, 1.7078: 16, 1.8257: 8}
    assert rows.dropna(subset=FEATURES).count() == 40


def test_weights(training_frame):
    rows = training.label_rows(features.training_features(training_frame()))
    stats = training.transition_stats(rows).first()
    assert (stats.rows, stats.transitions, stats.sustained, stats.single_hop) == (40, 40, 2, 38)
    found = counts(training.with_weights(rows).select(F.round("weight", 6).alias("w")), "w")
    assert found == {0.930233: 38, 2.325581: 2}


def test_missing_current_class_is_a_transition(spark):
    rows = spark.createDataFrame([(None, 3, 3), (3, 3, 4), (2, 3, 1), (2, 3, None)], "aqi int, aqi_next int, aqi_next2 int")
    kinds = [r[0] for r in rows.select(training.transition_kind()).collect()]
    assert kinds == ["sustained", "steady", "single_hop", "sustained"]


def test_lags_stay_inside_a_series(frame):
    rows = [reading("a", h, 5, pm10=100.0) for h in range(6)] + [reading("b", h, 1, pm10=1.0) for h in range(6)]
    found = features.training_features(frame(rows))
    assert {(r.city_slug, r.pm10_lag1, r.aqi_delta_1h) for r in found.collect()} == {("a", 100.0, 0.0), ("b", 1.0, 0.0)}


@pytest.mark.parametrize("hour,sin,cos", [(0, 0.0, 1.0), (12, 0.0, -1.0), (6, 1.0, 0.0)])
def test_serving_hour(frame, hour, sin, cos):
    found = features.serving_features(frame([reading("a", hour + h, 2) for h in (-3, -2, -1, 0)])).first()
    assert (found.hour_sin, found.hour_cos) == (pytest.approx(sin, abs=1e-12), pytest.approx(cos, abs=1e-12))


def test_serving_fills_everything(frame):
    nothing = dict.fromkeys(["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"])
    found = features.serving_features(frame([reading("a", h, None, **nothing) for h in range(4)]))
    assert found.dropna(subset=FEATURES).count() == 1


def test_serving_takes_nan_as_missing(frame):
    columns = ["co", "no2", "pm2_5", "pm10"]
    found, expected = (
        features.serving_features(frame([reading("a", h, 2, **dict.fromkeys(columns, v)) for h in range(4)])).first()
        for v in (float("nan"), None)
    )
    assert found == expected


def test_serving_missing_class_takes_the_delta_median(frame):
    rows = [reading("a", 0, 4), reading("a", 1, 3), reading("a", 2, None), reading("a", 3, 2)]
    found = features.serving_features(frame(rows)).first()
    assert (found.aqi_delta_1h, found.aqi_delta_2h, found.aqi_delta_3h) == (2.0, -1.0, -2.0)


def test_gap_option(frame):
    df = frame([reading("a", h, h % 5 + 1) for h in range(13) if h != 5])
    # Hours 3 and 4 miss the hour ahead or, from 6 on, the hours behind.
    assert sorted(r.timestamp.hour for r in features.training_features(df).collect()) == [3, 4, 6, 7, 8, 9, 10, 11]
    strict = features.training_features(df, max_gap="1 HOUR")
    assert sorted(r.timestamp.hour for r in strict.collect()) == [3, 9, 10, 11]


def test_medians(spark):
    rows = [(float(i), 7.0, None, float(i % 3), 1e9 if i == 0 else float(i)) for i in range(10)]
    rows.append((float("nan"), None, None, None, None))
    df = spark.createDataFrame(rows, "even double, same double, none double, few double, wide double")
    found = quantiles.median_values(df, df.columns)
    assert found == {"even": 4.5, "same": 7.0, "few": 1.0, "wide": 5.5}


def test_median_with_one_heavy_value(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e5).alias("v")
    )
    expected = df.agg(F.median("v")).first()[0]
    assert quantiles.median_values(df, ["v"])["v"] == expected


def test_class_rounding(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(to_class("v")).collect()] == [2, 4, None, None, None]


def test_dew_point(spark):
    df = spark.createDataFrame([(20.0, 50.0), (20.0, 0.0), (None, 50.0), (20.0, None)], "t double, h double")
    assert [r[0] for r in df.select(dew_point("t", "h")).collect()] == [10.0, None, None, None]
