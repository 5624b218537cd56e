"""Golden values for back-test, metrics, trend and drift."""

import datetime as dt

import pytest
from conftest import at, reading
from pyspark.sql import functions as F

from stationcast.operators import cleaning, drift, metrics, scoring


def test_backtest_rows_and_truth(frame):
    made = scoring.backtest(frame([reading("a", h, h % 5 + 1) for h in range(8)])).orderBy("timestamp").collect()
    assert len(made) == 4
    assert [r.actual for r in made] == [(i + 4) % 5 + 1 for i in range(4)]
    assert [r.current_aqi for r in made] == [(i + 3) % 5 + 1 for i in range(4)]
    assert made[0].timestamp == at(4).replace(tzinfo=None)


@pytest.mark.parametrize("n,rows", [(4, 0), (5, 1), (15, 11)])
def test_backtest_needs_five_rows(frame, n, rows):
    assert scoring.backtest(frame([reading("a", h, 2) for h in range(n)])).count() == rows


def test_latest_forecast(frame):
    rows = [reading("a", h, 6 if h == 9 else 2) for h in range(10)] + [reading("b", h, 1) for h in range(3)]
    made = scoring.latest_forecast(frame(rows)).collect()
    assert [r.city_slug for r in made] == ["a"]
    assert (made[0].current_aqi, made[0].predicted_label, made[0].predicted_color) == (5, "Very Poor", "#960032")
    assert made[0].forecast_for - made[0].as_of == dt.timedelta(hours=1)
    assert sum(made[0].probabilities.values()) == 1.0


def test_latest_forecast_without_current_class(frame):
    made = scoring.latest_forecast(frame([reading("a", h, None if h == 3 else 2) for h in range(4)])).first()
    assert (made.current_aqi, made.current_label, made.current_color) == (None, "—", "#ccc")


PAIRS = [(1, 1)] * 3 + [(1, 2), (2, 2), (2, 2), (2, 1), (3, 2), (3, 3), (4, 5)]


def test_scores(spark):
    preds = spark.createDataFrame(PAIRS, "actual int, predicted int")
    found = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.per_class_scores(preds).collect()}
    assert found == {
        1: (0.75, 0.75, 0.75, 4),
        2: (0.5, 0.6667, 0.5714, 3),
        3: (1.0, 0.5, 0.6667, 2),
        4: (0.0, 0.0, 0.0, 1),
        5: (0.0, 0.0, 0.0, 0),
    }
    all_ = metrics.overall_scores(preds).first()
    assert (all_.n_predictions, all_.precision, all_.recall, all_.f1) == (10, 0.65, 0.6, 0.6048)
    assert metrics.per_class_scores(preds.limit(9)).count() == 0


def daily(spark, values):
    start = dt.date(2026, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "day date, accuracy double")


@pytest.mark.parametrize(
    "values,expected",
    [
        ([0.9] * 7 + [0.7] * 7, (0.7, 0.9, -0.2, True)),
        ([0.9] * 6 + [0.7] * 7, (0.7, None, None, False)),
        ([0.1] * 5 + [0.7] * 7 + [0.65] * 7, (0.65, 0.7, -0.05, False)),
    ],
)
def test_accuracy_summary(spark, values, expected):
    assert tuple(metrics.accuracy_summary(daily(spark, values)).first()) == expected


def test_accuracy_summary_needs_two_days(spark):
    assert metrics.accuracy_summary(daily(spark, [0.5])).count() == 0


def drift_rows():
    rows = []
    for h in range(48):
        old = h < 23
        rows.append(
            reading(
                "a", h, 2, co=(100.0 if h % 2 == 0 else 102.0) if old else 105.0, no=2.0 if old else 2.5,
                nh3=3.0 if old else None,
            )
        )
    return rows


@pytest.mark.parametrize("pooled", [False, True])
def test_drift_scores(frame, pooled):
    found = drift.Drift(frame(drift_rows()), 1, pooled)
    rows = {r.feature: r for r in found.features().collect()}
    assert (rows["co"].ref_mean, rows["co"].drift_score, rows["co"].flag) == (100.9565, 3.958, True)
    assert rows["no"].drift_score == 10.0
    assert (rows["so2"].drift_score, rows["so2"].flag) == (0.0, False)
    assert (rows["nh3"].drift_score, rows["nh3"].flag) == (None, False)
    sizes = found.windows().first()
    assert (sizes.ref_rows, sizes.recent_rows) == (23, 25)
    shares = {r["class"]: (r.ref_pct, r.recent_pct) for r in found.classes().collect()}
    assert shares == {1: (0.0, 0.0), 2: (100.0, 100.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (0.0, 0.0)}
    assert {r["class"]: r.ref_pct for r in found.predictions().collect()}[2] == 100.0


@pytest.mark.parametrize("hours", [range(9), [0, 1, 2, 3, *range(30, 50)]])
def test_drift_gates(frame, hours):
    found = drift.Drift(frame([reading("a", h, 2) for h in hours]), 1)
    for part in (found.features(), found.classes(), found.predictions(), found.windows()):
        assert part.count() == 0


def test_drift_does_not_depend_on_partitions(frame):
    df = frame(drift_rows())
    a = drift.Drift(df.repartition(1), 1).features()
    b = drift.Drift(df.repartition(7, "pm10", "timestamp"), 1).features()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_trend_needs_ten_readings_and_two_days(frame):
    for hours, days in ((9, 0), (12, 0), (40, 2)):
        df = frame([reading("a", h, 2) for h in range(hours)])
        daily = metrics.daily_accuracy(scoring.backtest(df))
        assert metrics.gated_trend(daily, df).count() == days, hours


def test_window_limits(frame):
    df = frame([reading("a", h, 2) for h in range(100)])
    preds = scoring.backtest(df)
    sizes = metrics.by_window(preds, (24, 48)).groupBy("window_hours").count().collect()
    assert {tuple(r) for r in sizes} == {(24, 27), (48, 51)}
    with pytest.raises(ValueError):
        scoring.history(df, hours=169)
    with pytest.raises(ValueError):
        metrics.accuracy_trend(preds, weeks=13)


def test_look_back_uses_the_month_folders(spark, frame, tmp_path):
    from stationcast.functions import year_month

    rows = [reading("a", 24 * d, 2) for d in range(100)]
    path = str(tmp_path / "t")
    frame(rows).withColumn("ym", year_month("timestamp")).write.partitionBy("ym").parquet(path)
    found = cleaning.look_back(spark.read.parquet(path), 48, as_of=at(24 * 99).replace(tzinfo=None))
    assert found.count() == 3
    assert found.select(F.input_file_name()).distinct().count() <= 3
    assert "PartitionFilters: [isnotnull(ym" in found._jdf.queryExecution().executedPlan().toString()
