"""Two-window drift of inputs, classes and forecasts, per series or pooled."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from stationcast.functions import clamp_class
from stationcast.operators.features import Medians, drift_features
from stationcast.operators.scoring import Forecaster, backtest, persistence
from stationcast.operators.series import MAX_SERIES_ROWS, Profile, profile, with_key_values
from stationcast.schemas import CLASSES, DRIFT_FEATURES

MIN_ROWS, MIN_WINDOW_ROWS, MIN_REFERENCE_VALUES = 10, 5, 2
SCORE_LIMIT = 10.0
_LABELS = [c for c, _, _ in CLASSES]


def two_windows(
    readings: DataFrame,
    days: int,
    pooled: bool = False,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
) -> DataFrame:
    """Rows of the last ``2 * days`` days before the newest one, with ``recent`` for the later half.

    The newest row is that of the series, or of all series when pooled.
    """
    rows = readings.withColumn("aqi", clamp_class("aqi"))
    span, half = (F.expr(f"INTERVAL {n} DAYS") for n in (2 * days, days))
    if pooled:
        last = readings.agg(F.max(ts)).scalar()
        return rows.where(F.col(ts) >= last - span).withColumn("recent", F.col(ts) >= last - half)
    newest = readings.groupBy(key).agg(F.max(ts).alias("_last"))
    return (
        with_key_values(rows, newest, key, stats.series if stats else None, spread_by=ts)
        .where(F.col(ts) >= F.col("_last") - span)
        .withColumn("recent", F.col(ts) >= F.col("_last") - half)
        .drop("_last")
    )


def enough_rows(rows: DataFrame) -> DataFrame:
    enough = (
        (F.col("ref_rows") >= MIN_WINDOW_ROWS)
        & (F.col("recent_rows") >= MIN_WINDOW_ROWS)
        & (F.col("ref_rows") + F.col("recent_rows") >= MIN_ROWS)
    )
    return rows.where(enough)


def _summary(rows: DataFrame, by: list[str], aggregates: list[str]) -> DataFrame:
    sizes = ["count_if(NOT recent) AS ref_rows", "count_if(recent) AS recent_rows"]
    return enough_rows(rows.groupBy(*by).agg(*map(F.expr, [*sizes, *aggregates])))


def _settled(expression: str, digits: int) -> str:
    return f"bround(round({expression}, {digits + 5}), {digits})"


def feature_drift(rows: DataFrame, by: list[str], flag_above: float = 1.0) -> DataFrame:
    """Shift of each input's mean in units of its reference deviation.

    One aggregate with all inputs side by side; only its result is turned into long form. The
    deviation is never taken below 1 % of the scale of the mean. Inputs with fewer than two reference
    values are left out, inputs without recent values score null.
    """
    aggregates = []
    for f in DRIFT_FEATURES:
        aggregates += [
            f"count({f}) FILTER (WHERE NOT recent) AS n_{f}",
            f"avg({f}) FILTER (WHERE NOT recent) AS mean_{f}",
            f"stddev_samp({f}) FILTER (WHERE NOT recent) AS std_{f}",
            f"avg({f}) FILTER (WHERE recent) AS new_{f}",
        ]
    return shift_of_means(_summary(rows, by, aggregates), by, flag_above)


def shift_of_means(summary: DataFrame, by: list[str], flag_above: float = 1.0) -> DataFrame:
    """A8 from ``n_f``, ``mean_f``, ``std_f`` of the reference window and ``new_f`` of the recent one, for each input f."""
    long = []
    for f in DRIFT_FEATURES:
        scale = f"greatest(std_{f}, 0.01D * greatest(abs(mean_{f}), 1D))"
        raw = f"(new_{f} - mean_{f}) / {scale}"
        # least and greatest skip nulls.
        score = f"CASE WHEN new_{f} IS NOT NULL THEN greatest({-SCORE_LIMIT}D, least({SCORE_LIMIT}D, {raw})) END"
        long.append(
            f"struct('{f}' AS feature, n_{f} AS ref_n, {_settled(f'mean_{f}', 4)} AS ref_mean, "
            f"{_settled(f'new_{f}', 4)} AS recent_mean, {_settled(score, 3)} AS drift_score)"
        )
    return (
        summary.selectExpr(*by, f"inline(array({', '.join(long)}))")
        .where(F.col("ref_n") >= MIN_REFERENCE_VALUES)
        .drop("ref_n")
        .withColumn("flag", F.coalesce(F.abs("drift_score") > flag_above, F.lit(False)))
    )


def _shares(column: str) -> tuple[list[str], str]:
    """Counts per window and class, and the long form built from them."""
    aggregates = [
        f"count({column}) FILTER (WHERE NOT recent) AS n_ref",
        f"count({column}) FILTER (WHERE recent) AS n_new",
    ]
    for c in _LABELS:
        aggregates += [
            f"count_if(NOT recent AND {column} = {c}) AS ref_{c}",
            f"count_if(recent AND {column} = {c}) AS new_{c}",
        ]

    return aggregates, class_percentages()


def class_percentages() -> str:
    """SQL: one row per class from ``n_ref``, ``n_new`` and the counts ``ref_c`` and ``new_c`` of each class c."""

    def percent(part: str, whole: str) -> str:
        return f"bround(coalesce(try_divide(CAST({part} AS DOUBLE), {whole}), 0D) * 100, 1)"

    long = ", ".join(
        f"struct({c} AS class, {percent(f'ref_{c}', 'n_ref')} AS ref_pct, {percent(f'new_{c}', 'n_new')} AS recent_pct)"
        for c in _LABELS
    )
    return f"inline(array({long}))"


def class_shift(rows: DataFrame, by: list[str]) -> DataFrame:
    """Percentage of each class 1-5 in both windows, absent classes as 0."""
    aggregates, long = _shares("aqi")
    return _summary(rows, by, aggregates).selectExpr(*by, long)


def window_bounds(rows: DataFrame, by: list[str], ts: str = "timestamp") -> DataFrame:
    """Row counts and time span of both windows."""
    return _summary(
        rows,
        by,
        [
            f"min(`{ts}`) FILTER (WHERE NOT recent) AS ref_from",
            f"max(`{ts}`) FILTER (WHERE NOT recent) AS ref_to",
            f"min(`{ts}`) FILTER (WHERE recent) AS recent_from",
            f"max(`{ts}`) FILTER (WHERE recent) AS recent_to",
        ],
    )


def prediction_shift(
    rows: DataFrame,
    by: list[str],
    forecast: Forecaster = persistence,
    medians: Medians | None = None,
    key: str = "city_slug",
    ts: str = "timestamp",
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Percentage of each forecast class in both windows (A10).

    Each window is back-tested on its own, so each loses its first rows. There is no output unless
    both windows give forecasts; since that takes five rows in a window, the row gates hold then.
    """
    split = rows.withColumn("_series", F.struct(key, "recent"))
    made = backtest(split, forecast, medians, "_series", ts, stats, max_rows)
    flat = made.select(F.col(f"_series.{key}").alias(key), F.col("_series.recent").alias("recent"), "predicted")
    aggregates, long = _shares("predicted")
    return (
        flat.groupBy(*by).agg(*map(F.expr, aggregates)).where("n_ref > 0 AND n_new > 0").selectExpr(*by, long)
    )


@dataclass(frozen=True)
class Drift:
    """Drift over one window length; every result is in long form, led by the key unless pooled.

    Lags are taken per series even when pooled.
    """

    readings: DataFrame
    days: int = 1
    pooled: bool = False
    forecast: Forecaster = persistence
    medians: Medians | None = None
    key: str = "city_slug"
    ts: str = "timestamp"
    stats: Profile | None = None
    max_rows: int = MAX_SERIES_ROWS
    flag_above: float = 1.0

    @cached_property
    def _stats(self) -> Profile:
        return self.stats or profile(self.readings, self.key)

    @cached_property
    def _rows(self) -> DataFrame:
        stats = self.stats if self.pooled else self._stats
        return two_windows(self.readings, self.days, self.pooled, self.key, self.ts, stats)

    @property
    def _by(self) -> list[str]:
        return [] if self.pooled else [self.key]

    def features(self) -> DataFrame:
        inputs = drift_features(self._rows, self.key, self.ts, self._stats, self.max_rows)
        return feature_drift(inputs, self._by, self.flag_above)

    def classes(self) -> DataFrame:
        return class_shift(self._rows, self._by)

    def predictions(self) -> DataFrame:
        return prediction_shift(
            self._rows, self._by, self.forecast, self.medians, self.key, self.ts, self._stats, self.max_rows
        )

    def windows(self) -> DataFrame:
        return window_bounds(self._rows, self._by, self.ts)
