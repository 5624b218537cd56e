"""Drift from daily moments against drift over all rows."""

import random

import pytest
from conftest import reading

from stationcast.operators import drift, moments
from stationcast.operators.features import readable
from stationcast.schemas import DRIFT_FEATURES


def series(seed):
    """Hourly, sparse and uneven series with gaps, missing values and class 6."""
    rng = random.Random(seed)
    rows = []
    for s, every in (("hourly", 1), ("sparse", 19), ("uneven", 5), ("short", 3)):
        h = rng.randrange(40)
        while h < (500 if s != "short" else 60):
            value = {c: rng.choice([None, rng.uniform(0, 90)]) for c in ("co", "no2", "nh3")}
            rows.append(reading(s, h + rng.random() * 0.5, rng.choice([None, 1, 2, 3, 6]), pm10=1e6 + rng.random(), **value))
            h += rng.randrange(1, 2 * every)
    return rows


@pytest.mark.parametrize("days, pooled", [(1, False), (7, False), (1, True), (7, True)])
def test_drift_equals_that_of_all_rows(frame, days, pooled):
    readings = readable(frame(series(days)))
    rows = moments.drift_rows(readings)
    state = moments.daily_moments(rows)
    mine, whole = moments.MomentDrift(state, rows, days, pooled), drift.Drift(readings, days, pooled)
    for part in ("features", "classes", "windows"):
        found, want = (sorted(map(repr, getattr(x, part)().collect())) for x in (mine, whole))
        assert found == want and want


def test_merging_keeps_small_deviations_of_large_values(frame):
    rows = moments.drift_rows(readable(frame([reading(s, h, 2, pm10=1e9 + h % 3) for s in "ab" for h in range(200)])))
    whole = moments._moments(rows, ["city_slug"], "timestamp")
    merged = moments.merge_moments(moments.daily_moments(rows), ["city_slug"])
    a, b = ({r.city_slug: r for r in x.collect()} for x in (whole, merged))
    for s in a:
        for f in DRIFT_FEATURES:
            assert b[s][f"n_{f}"] == a[s][f"n_{f}"] and b[s][f"mean_{f}"] == pytest.approx(a[s][f"mean_{f}"], rel=1e-12)
            assert b[s][f"m2_{f}"] == pytest.approx(a[s][f"m2_{f}"], rel=1e-6, abs=1e-9)


def test_only_cut_days_are_read_as_rows(frame):
    readings = readable(frame([reading("a", h + 0.5, h % 5 + 1) for h in range(24 * 30)]))
    rows = moments.drift_rows(readings)
    kept = rows.where("day in (date'2026-01-16', date'2026-01-17', date'2026-01-23')")
    state = moments.daily_moments(rows)
    assert sorted(moments.MomentDrift(state, kept, 7).features().collect()) == sorted(drift.Drift(readings, 7).features().collect())
