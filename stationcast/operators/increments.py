"""Scores kept up to date by signed changes, without a back-test of what did not change.

The state is made of cells: ``key, day, actual, predicted, n`` counts the back-test rows of a series on a day with
that pair of classes, and every score of A12 and A13 is a sum over cells. When readings are merged into silver,
only back-test rows with a changed reading among the five they read (their own and the four before it) can
change. For the touched series these rows and what they read are taken out of the merged readings, which hold the
values before and after, back-tested with either, and counted with a minus and a plus.

The rows are found by position, not by a span of time, so gaps of any length are right. Finding them reads the
touched series once; the back-test sees at most nine rows for a changed reading.

A batch may hold the same reading several times, readings that equal those in silver, new series and times before,
between and behind the known ones. Readings without a key or a time are no part of silver and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stationcast.functions import half_even
from stationcast.operators import metrics
from stationcast.operators.cleaning import union_all
from stationcast.operators.features import LOOK_BACK, Medians
from stationcast.operators.scoring import Forecaster, backtest, persistence
from stationcast.operators.series import MAX_BROADCAST_ROWS, MAX_SERIES_ROWS, Profile, over_series, profile
from stationcast.schemas import CLASSES

# A back-test row is named by the row it predicts; it reads that row and so many before it.
READS_BACK = LOOK_BACK + 1
CELL = ["day", "actual", "predicted"]


def cells(predictions: DataFrame, key: str = "city_slug", ts: str = "timestamp") -> DataFrame:
    """``key, day, actual, predicted, n`` of labelled back-test rows."""
    return _counted(metrics.labelled(predictions).withColumn("_sign", F.lit(1)), key, ts)


def _counted(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows by cell, those with a ``_sign`` of -1 taken away."""
    return rows.withColumn("day", F.to_date(ts)).groupBy(key, *CELL).agg(F.sum("_sign").alias("n"))


def merged_cells(parts: list[DataFrame], key: str = "city_slug") -> DataFrame:
    """The sum of cells and signed changes; empty cells go."""
    return union_all(parts).groupBy(key, *CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def _of_keys(readings: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The readings of some series."""
    few = keys.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return readings.join(F.broadcast(keys) if few else keys, key, "left_semi")


def near_changes(
    readings: DataFrame, changed: DataFrame | None, key: str = "city_slug", ts: str = "timestamp",
    stats: Profile | None = None, max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Rows with a changed time at most ``READS_BACK`` rows away, and ``_hit`` on those whose back-test may differ.

    ``changed`` holds distinct ``key, ts``; its times need not be among the readings. None: the readings say it themselves by 1
    or 0 in ``_changed``. For a row with ``_hit`` all the rows it reads are returned, so its back-test on the result is its
    back-test on the whole series. ``_next_hit`` is the ``_hit`` of the row that is forecast from this one.

    A changed time without a row counts as a row. It is a change itself, so between a row and the change nearest to
    it there are only rows, and nothing within reach of a change is lost.
    """
    if changed is not None:
        marks = changed.select(key, ts, F.lit(1).alias("_changed"))
        known = _of_keys(readings, marks.select(key).distinct(), key).withColumn("_row", F.lit(True))
        readings = known.join(marks, [key, ts], "full_outer").withColumn("_changed", F.coalesce("_changed", F.lit(0)))
    wide = {
        "_near": ("max(_changed)", f"ROWS BETWEEN {READS_BACK} PRECEDING AND {READS_BACK} FOLLOWING"),
        "_hit": ("max(_changed)", f"ROWS BETWEEN {READS_BACK} PRECEDING AND CURRENT ROW"),
        "_next_hit": ("max(_changed)", f"ROWS BETWEEN {READS_BACK - 1} PRECEDING AND 1 FOLLOWING"),
    }
    near = over_series(readings, key, ts, wide, READS_BACK, READS_BACK, stats, max_rows).where("_near = 1")
    near = near.withColumns({c: F.col(c) == 1 for c in ("_hit", "_next_hit")}).drop("_near", "_changed")
    return near if changed is None else near.where("_row").drop("_row")


def cells_near(
    near: DataFrame, forecast: Forecaster = persistence, medians: Medians | None = None,
    key: str = "city_slug", ts: str = "timestamp", stats: Profile | None = None, max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Cells of the back-test rows that the changed times reach, from the rows near them.

    ``near`` has ``_next_hit``, and in ``_sign`` 1 on readings as they are and -1 on readings as they were: a series each.
    """
    own = near.schema[key].dataType
    sides = near.withColumn("_series", F.concat(F.when(F.col("_sign") > 0, "+").otherwise("-"), F.col(key).cast("string")))
    made = metrics.labelled(backtest(sides.drop("_sign"), forecast, medians, "_series", ts, stats, max_rows, only="_next_hit"))
    sign = F.when(F.col("_series").startswith("+"), 1).otherwise(-1)
    made = made.withColumns({key: F.expr("substring(_series, 2)").cast(own), "_sign": sign})
    return _counted(made, key, ts).where("n <> 0")


def _traced(before: DataFrame | None, after: DataFrame, batch: DataFrame, key: str, ts: str) -> DataFrame:
    """``after`` as ``upsert`` gives it with ``trace``, for the series of the batch."""
    marks = batch.select(key, ts, F.lit(True).alias("_new")).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct()
    keys = marks.select(key).distinct()
    rows = _of_keys(after, keys, key).join(marks, [key, ts], "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    others = [c for c in after.columns if c not in (key, ts)]
    if before is None:
        return rows.withColumns({"_old": F.lit(False), **{f"_was_{c}": F.lit(None).cast(after.schema[c].dataType) for c in others}})
    was = _of_keys(before, keys, key).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(True).alias("_old"), *[F.col(c).alias(f"_was_{c}") for c in others])
    # A time may be null and is found again all the same.
    rows = rows.join(was, F.col(key).eqNullSafe(F.col("_key")) & F.col(ts).eqNullSafe(F.col("_ts")), "left").drop("_key", "_ts")
    return rows.withColumn("_old", F.coalesce("_old", F.lit(False)))


def signed_changes(
    before: DataFrame | None, after: DataFrame, batch: DataFrame, forecast: Forecaster = persistence,
    medians: Medians | None = None, key: str = "city_slug", ts: str = "timestamp", stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """What a batch does to the cells: ``n`` is below zero where it takes rows away.

    ``before`` and ``after`` are the readings around the merge of ``batch``; None: there were none yet. If ``after`` has the
    columns that ``upsert`` adds with ``trace``, neither of the others is read. ``stats`` may bound
    the length of a series from above.

    Both sides come from one pass over ``after``. A reading is never taken out, so the rows of ``before`` near a change are
    those among the rows of ``after`` near it that were there before.
    """
    rows = after if "_old" in after.columns else _traced(before, after, batch, key, ts)
    stats = stats or profile(rows, key)
    values = [c for c in rows.columns if f"_was_{c}" in rows.columns]
    near = near_changes(rows.withColumn("_changed", F.col("_new").cast("int")), None, key, ts, stats, max_rows)
    if before is None:
        sides = near.withColumn("_sign", F.lit(1))
    else:
        both = near.withColumn("_sign", F.explode(F.array(F.lit(1), F.lit(-1)))).where("_sign = 1 OR _old")
        sides = both.withColumns({c: F.when(F.col("_sign") > 0, F.col(c)).otherwise(F.col(f"_was_{c}")) for c in values})
    return cells_near(sides.select(key, ts, *values, "_sign", "_next_hit"), forecast, medians, key, ts, stats, max_rows)


def _tally(state: DataFrame, by: list[str]) -> DataFrame:
    def rows(condition: str) -> str:
        return f"coalesce(sum(n) FILTER (WHERE {condition}), 0)"

    counts = ["coalesce(sum(n), 0) AS n_predictions"]
    for c, _, _ in CLASSES:
        counts += [
            f"{rows(f'actual = {c} AND predicted = {c}')} AS tp_{c}",
            f"{rows(f'predicted = {c}')} AS said_{c}",
            f"{rows(f'actual = {c}')} AS support_{c}",
        ]
    return state.groupBy(*by).agg(*map(F.expr, counts)).where(F.col("n_predictions") >= metrics.MIN_LABELLED)


def per_class_scores(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A12 from cells: the rows of ``metrics.per_class_scores`` over the whole back-test."""
    return metrics.class_scores(_tally(state, by or []), by or [])


def overall_scores(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A12 averages from cells."""
    return metrics.average_scores(_tally(state, by or []), by or [])


def daily_accuracy(state: DataFrame) -> DataFrame:
    """A13 from cells: a row per day."""
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    days = state.groupBy("day").agg(F.sum("n").alias("total"), hits.alias("_hits"))
    return days.select("day", "total", half_even(F.col("_hits") / F.col("total"), 4).alias("accuracy"))
