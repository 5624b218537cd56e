"""Scores by signed changes against the back-test of everything."""

import random

import pytest
from conftest import reading
from pyspark.sql import functions as F

from stationcast.operators import increments, metrics, scoring
from stationcast.operators.features import readable
from stationcast.operators.series import Profile
from stationcast.operators.upsert import upsert
from stationcast.plans.scores import ScoreLog, merge_and_score
from stationcast.sinks.files import remove
from stationcast.sources.tables import read_silver


def rows_of(df):
    return sorted(tuple(r) for r in df.select("city_slug", "day", "actual", "predicted", "n").collect())


def whole(readings):
    return increments.cells(scoring.backtest(readable(readings)))


def batches(seed, series=3, hours=60):
    """Readings with gaps in time: some arrive late, some again with another class, some repeated in one batch."""
    rng = random.Random(seed)
    known = {}
    out = []
    for _ in range(3):
        batch = []
        for _ in range(rng.randrange(1, 25)):
            s, h = rng.randrange(series), rng.choice([rng.randrange(hours), rng.randrange(hours) * 40])
            aqi = rng.choice([None, 1, 2, 3, 4, 5, 6])
            if (s, h) in known and rng.random() < 0.3:
                aqi = known[s, h]
            known[s, h] = aqi
            batch.append(reading(f"s{s}", h, aqi))
            if rng.random() < 0.1:
                batch.append(batch[-1])
        out.append(batch)
    return out


@pytest.mark.parametrize("max_rows", [5_000_000, 8])
def test_signed_changes_equal_the_difference(frame, max_rows):
    before, state = None, None
    for batch in batches(max_rows % 7):
        rows = frame(batch)
        # Of a reading with several values in one batch one is taken, whichever: give them one.
        rows = rows.dropDuplicates(["city_slug", "timestamp"])
        after = upsert(before if before is not None else rows.limit(0), rows)
        after = frame([tuple(r[c] for c in ("timestamp", "city", "city_slug", "aqi", "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3", "source")) for r in after.collect()])
        change = increments.signed_changes(None if before is None else readable(before), readable(after), rows, max_rows=max_rows)
        change = change.sparkSession.createDataFrame(change.collect(), change.schema)
        state = change if state is None else increments.merged_cells([state, change])
        assert rows_of(state) == rows_of(whole(after))
        before = after


def test_only_rows_near_a_change_are_read(frame):
    rows = frame([reading("a", h, 2) for h in range(100)] + [reading("b", h, 2) for h in range(100)])
    changed = frame([reading("a", 50, 3), reading("a", 70.5, 3), reading("c", 1, 1)]).select("city_slug", "timestamp")
    near = {(r.city_slug, r.timestamp.hour + 24 * (r.timestamp.day - 1)): r._hit for r in increments.near_changes(rows, changed).collect()}
    assert sorted(near) == [("a", h) for h in [*range(46, 55), *range(67, 75)]]
    assert [h for (_, h), hit in sorted(near.items()) if hit] == [50, 51, 52, 53, 54, 71, 72, 73, 74]


def test_keys_and_times_that_are_null_change_nothing(frame, spark):
    rows = frame([reading("a", h, 2) for h in range(10)])
    batch = rows.limit(1).withColumn("city_slug", F.lit(None).cast("string")).unionByName(rows.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")))
    assert increments.signed_changes(rows, rows, batch).count() == 0
    assert increments.signed_changes(None, rows.limit(0), rows.limit(0)).count() == 0


def test_changes_take_one_pass_over_the_merged_readings(frame):
    before = frame([reading("a", h, h % 6 + 1) for h in range(30)] + [reading("b", h, 2) for h in range(12)])
    batch = frame([reading("a", h, 3) for h in (0.5, 12, 12.5, 12.7, 20, 40)] + [reading("b", -1, 4), reading("b", 3, 2)] + [reading("c", h, 1) for h in range(6)])
    after = upsert(before, batch, trace=True)
    told = {(r.city_slug, r.timestamp): (r._old, r._new, r._was_aqi) for r in after.where("_new").collect()}
    assert sorted(told.values(), key=str) == [(False, True, None)] * 11 + [(True, True, 1), (True, True, 2), (True, True, 3)]
    traced = readable(after).withColumn("_was_aqi", F.least("_was_aqi", F.lit(5)))
    change = increments.signed_changes(readable(before), traced, batch, stats=Profile(100, 3, 100))
    # Target, source, series of the merged rows, series of both sides, cells.
    assert change._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5
    assert rows_of(increments.merged_cells([whole(before), change])) == rows_of(whole(after.select(*before.columns)))
    generic = increments.signed_changes(readable(before), readable(after.select(*before.columns)), batch)
    assert rows_of(generic) == rows_of(change)


def test_scores_from_cells_equal_those_from_rows(frame):
    made = scoring.backtest(frame([reading(f"s{s}", h, (h * (s + 2)) % 5 + 1) for s in range(3) for h in range(40)]))
    state = increments.cells(made)
    for by in (None, ["city_slug"]):
        assert sorted(increments.per_class_scores(state, by).collect()) == sorted(metrics.per_class_scores(made, by).collect())
        assert sorted(increments.overall_scores(state, by).collect()) == sorted(metrics.overall_scores(made, by).collect())
    assert sorted(increments.daily_accuracy(state).collect()) == sorted(metrics.daily_accuracy(made).collect())
    assert increments.per_class_scores(state.limit(0)).count() == 0


def test_log_counts_a_batch_once_wherever_it_stopped(spark, frame, tmp_path):
    silver, log = str(tmp_path / "silver"), ScoreLog(spark, str(tmp_path / "log"))
    assert log.cells() is None
    first = frame([reading("a", h, h % 5 + 1) for h in range(20)])
    late = frame([reading("a", h + 0.5, 3) for h in range(3, 6)] + [reading("b", h, 2) for h in range(8)])
    merge_and_score(spark, silver, log, "1", first)
    # The changes of the second batch are written, the merge into silver is not; then it all runs again, twice.
    after = upsert(read_silver(spark, silver, clamp=False).select(*first.columns), late)
    log.write("2", increments.signed_changes(readable(read_silver(spark, silver, clamp=False)), readable(after), late))
    for _ in range(2):
        merge_and_score(spark, silver, log, "2", late)
    want = rows_of(whole(read_silver(spark, silver, clamp=False)))
    assert rows_of(log.cells()) == want
    log.fold()
    log.fold()
    assert rows_of(log.cells()) == want
    merge_and_score(spark, silver, log, "3", frame([reading("b", 30, 1)]))
    want = rows_of(whole(read_silver(spark, silver, clamp=False)))
    assert rows_of(log.cells()) == want
    # A sum without its list of batches is not valid yet; an unfinished batch does not count.
    log.fold()
    remove(spark, f"{log.path}/sums/2/batches/_SUCCESS")
    assert rows_of(log.cells()) == want
    remove(spark, f"{log.path}/changes/3/_SUCCESS")
    assert rows_of(log.cells()) != want
    with pytest.raises(ValueError):
        log.write("a/b", first)
