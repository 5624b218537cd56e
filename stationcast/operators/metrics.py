"""Precision, recall and F1, and the daily accuracy trend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from stationcast.functions import half_even, settled
from stationcast.operators.cleaning import as_of_column, look_back
from stationcast.schemas import CLASSES, HISTORY_HOURS

_LABELS = [c for c, _, _ in CLASSES]
MIN_LABELLED = 10


def labelled(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def _tally(predictions: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and support of every class in one aggregate, no class left out."""
    counts = ["count(*) AS n_predictions"]
    for c in _LABELS:
        counts += [
            f"count_if(actual = {c} AND predicted = {c}) AS tp_{c}",
            f"count_if(predicted = {c}) AS said_{c}",
            f"count_if(actual = {c}) AS support_{c}",
        ]
    rows = labelled(predictions)
    return rows.groupBy(*by).agg(*map(F.expr, counts)).where(F.col("n_predictions") >= MIN_LABELLED)


def _ratio(a: str, b: str) -> str:
    return f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)"


def _scores(tally: DataFrame, by: list[str]) -> DataFrame:
    per_class = ", ".join(
        f"struct({c} AS class, {_ratio(f'tp_{c}', f'said_{c}')} AS precision, "
        f"{_ratio(f'tp_{c}', f'support_{c}')} AS recall, "
        f"{_ratio(f'2 * tp_{c}', f'said_{c} + support_{c}')} AS f1, support_{c} AS support)"
        for c in _LABELS
    )
    return tally.selectExpr(*by, "n_predictions", f"array({per_class}) AS scores")


def per_class_scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support for classes 1-5, rounded to 4 digits.

    Without at least ten labelled rows there is no output.
    """
    by = by or []
    return class_scores(_tally(predictions, by), by)


def class_scores(tally: DataFrame, by: list[str]) -> DataFrame:
    """Scores of each class from its counts."""
    rows = _scores(tally, by).select(*by, F.inline("scores"))
    return rows.withColumns({c: half_even(c, 4) for c in ("precision", "recall", "f1")})


def overall_scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support-weighted and macro averages over the five classes."""
    by = by or []
    return average_scores(_tally(predictions, by), by)


def average_scores(tally: DataFrame, by: list[str]) -> DataFrame:
    """Averages over the classes from their counts."""
    rows = _scores(tally, by)

    def weighted(name: str) -> Column:
        total = f"aggregate(scores, 0D, (acc, s) -> acc + s.{name} * s.support)"
        return settled(F.expr(_ratio(total, "n_predictions")), 4).alias(name)

    macro = F.expr(f"aggregate(scores, 0D, (acc, s) -> acc + s.f1) / {len(_LABELS)}")
    return rows.select(
        *by, "n_predictions", weighted("precision"), weighted("recall"), weighted("f1"),
        settled(macro, 4).alias("f1_macro"),
    )


def by_window(
    predictions: DataFrame,
    hours: tuple[int, ...] = HISTORY_HOURS,
    slack_hours: int = 2,
    ts: str = "timestamp",
    as_of: dt.datetime | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Copy each prediction into the look-back windows that hold it; group by ``window_hours`` next.

    ``as_of`` defaults to the newest time of ``newest`` (the readings; else the predictions).
    """
    last = as_of_column(predictions if newest is None else newest, ts, as_of)
    longest = last - F.make_dt_interval(hours=F.lit(max(hours) + slack_hours))
    windows = F.array(
        *[F.when(F.col(ts) >= last - F.make_dt_interval(hours=F.lit(h + slack_hours)), h) for h in hours]
    )
    return (
        predictions.where(F.col(ts) >= longest)
        .withColumn("window_hours", F.explode(windows))
        .where(F.col("window_hours").isNotNull())
    )


def daily_accuracy(predictions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Predictions and accuracy per UTC date of the predicted hour."""
    hit = (F.col("actual") == F.col("predicted")).cast("int")
    return (
        labelled(predictions)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("total"), F.sum(hit).alias("_hits"))
        .select("day", "total", half_even(F.col("_hits") / F.col("total"), 4).alias("accuracy"))
    )


def gated_trend(daily: DataFrame, readings: DataFrame, least_rows: int = 10, least_days: int = 2) -> DataFrame:
    """Daily values, or none where there are too few readings or days for a trend (P14). ``daily`` has a row per day."""
    enough = readings.limit(least_rows).agg(F.count("*") >= least_rows).scalar()
    days = F.count("*").over(Window.partitionBy())
    return daily.withColumn("_days", days).where(enough & (F.col("_days") >= least_days)).drop("_days")


def accuracy_summary(daily: DataFrame, drop_of: float = 0.10) -> DataFrame:
    """Mean of the last seven daily values against the seven before.

    By position, not by calendar, and unweighted. Needs two days; the comparison needs fourteen.
    """
    last = daily.orderBy(F.desc("day")).limit(14)
    # Fourteen rows at most.
    row = last.agg(F.sort_array(F.collect_list(F.struct("day", "accuracy")), False).alias("d"))

    def mean(first):
        part = F.slice("d", first, 7)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["accuracy"]) / F.size(part)

    week = row.where(F.size("d") >= 2).select(
        mean(1).alias("_last"), F.when(F.size("d") >= 14, mean(8)).alias("_prior")
    )
    delta = settled(F.col("_last") - F.col("_prior"), 4)
    return week.select(
        settled("_last", 4).alias("last_7d_accuracy"),
        settled("_prior", 4).alias("prior_7d_accuracy"),
        delta.alias("wow_delta"),
        F.coalesce(delta < -drop_of, F.lit(False)).alias("concept_drift_flag"),
    )


def accuracy_trend(
    predictions: DataFrame, weeks: int = 8, ts: str = "timestamp", as_of: dt.datetime | None = None
) -> DataFrame:
    """Daily accuracy over the last weeks."""
    if not 2 <= weeks <= 12:
        raise ValueError(f"weeks must be within 2..12, not {weeks}")
    return daily_accuracy(look_back(predictions, weeks * 7 * 24, ts, as_of), ts)
