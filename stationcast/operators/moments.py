"""Drift of inputs from mergeable moments: whole days are summed up once and never read again.

For each series and day the state holds the number of rows, the counts of the classes, the first and last time,
and of every drift input the count, the mean and the sum of squared deviations. Two windows before any moment are
merged from whole days; only the days a window border cuts, and the first days of a series inside the windows,
are read as rows: the first three rows there lack neighbours that the stored moments had.

Means and deviations are merged pairwise: counts and means first, then each part's squares plus what its mean is
off the merged one. No difference of large sums is taken. The results are those of ``drift.Drift`` over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stationcast.functions import clamp_class, sample_std, share_of_total
from stationcast.operators.drift import class_percentages, enough_rows, shift_of_means
from stationcast.operators.features import LOOK_BACK, with_neighbours
from stationcast.operators.series import MAX_SERIES_ROWS, Profile, with_key_values
from stationcast.schemas import CLASSES, DRIFT_FEATURES

_LABELS = [c for c, _, _ in CLASSES]
_LAGS = [f"aqi_lag{k}" for k in range(1, LOOK_BACK + 1)]


def drift_rows(
    readings: DataFrame, key: str = "city_slug", ts: str = "timestamp", stats: Profile | None = None, max_rows: int = MAX_SERIES_ROWS
) -> DataFrame:
    """``key, ts, day``, the class, its lags and the drift inputs of every reading; written by day it serves the cut days."""
    rows = with_neighbours(readings.withColumn("aqi", clamp_class("aqi")), key, ts, stats, max_rows, only=["pm10_lag1", *_LAGS])
    made = rows.withColumns(
        {
            "day": F.to_date(ts),
            "aqi_roll_std4": sample_std(["aqi", *_LAGS]),
            "pm25_ratio": share_of_total("pm2_5", ["pm10", "no2", "o3", "so2"], nulls="null"),
        }
    )
    return made.select(key, ts, "day", "aqi", *_LAGS, *DRIFT_FEATURES)


def _moments(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """The state of groups of rows."""
    parts = [F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")]
    parts += [F.count_if(F.col("aqi") == c).alias(f"class_{c}") for c in _LABELS] + [F.count("aqi").alias("classes")]
    for f in DRIFT_FEATURES:
        parts += [F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"mean_{f}"), (F.var_pop(f) * F.count(f)).alias(f"m2_{f}")]
    return rows.groupBy(*by).agg(*parts)


def daily_moments(rows: DataFrame, key: str = "city_slug", ts: str = "timestamp") -> DataFrame:
    """One row per series and day from ``drift_rows``. A day is computed again when one of its readings changes."""
    return _moments(rows, [key, "day"], ts)


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of groups of parts, merged pairwise."""
    plain = ["rows", "classes", *[f"class_{c}" for c in _LABELS]]
    sums = [F.sum(c).alias(c) for c in plain] + [F.min("first").alias("first"), F.max("last").alias("last")]
    for f in DRIFT_FEATURES:
        weighted = F.sum(F.col(f"n_{f}") * F.col(f"mean_{f}"))
        sums += [F.sum(f"n_{f}").alias(f"n_{f}"), F.try_divide(weighted, F.sum(f"n_{f}")).alias(f"mean_{f}")]
    centre = parts.groupBy(*by).agg(*sums)
    named = centre.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(f"mean_{f}").alias(f"_mean_{f}") for f in DRIFT_FEATURES])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    off = parts.join(named, same)
    squares = []
    for f in DRIFT_FEATURES:
        away = F.col(f"mean_{f}") - F.col(f"_mean_{f}")
        squares.append(F.sum(F.col(f"m2_{f}") + F.col(f"n_{f}") * away * away).alias(f"m2_{f}"))
    spread = off.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*squares)
    return centre.join(spread, same).drop(*[f"_{c}" for c in by])


@dataclass(frozen=True)
class MomentDrift:
    """Drift over one window length from the daily state; ``rows`` (``drift_rows``) is read for the cut days only."""

    state: DataFrame
    rows: DataFrame
    days: int = 1
    pooled: bool = False
    key: str = "city_slug"
    ts: str = "timestamp"
    flag_above: float = 1.0
    n_series: int | None = None

    def _borders(self) -> DataFrame:
        """``key, _start, _half``: where the two windows of each series begin."""
        newest = self.state.groupBy(self.key).agg(F.max("last").alias("_last"))
        if self.pooled:
            newest = newest.withColumn("_last", self.state.agg(F.max("last")).scalar())
        back = {"_start": 2 * self.days, "_half": self.days}
        return newest.select(self.key, *[(F.col("_last") - F.expr(f"INTERVAL {n} DAYS")).alias(c) for c, n in back.items()])

    def windows_state(self) -> DataFrame:
        """The moments of both windows, ``recent`` and, unless pooled, the key in front."""
        key, ts = self.key, self.ts
        borders = self._borders()
        first, cut = F.to_date("_start"), F.to_date("_half")
        days = with_key_values(self.state, borders, key, self.n_series, spread_by="day").where(F.col("day") >= first)
        # Rows on earlier whole days of the windows; the first day counts none, since it may be cut behind all of them.
        seen = F.sum(F.when(F.col("day") > first, F.col("rows")).otherwise(0)).over(Window.partitionBy(key).orderBy("day"))
        days = days.withColumn("_seen", seen - F.when(F.col("day") > first, F.col("rows")).otherwise(0))
        edge = (F.col("day") == first) | (F.col("day") == cut) | (F.col("_seen") < LOOK_BACK)
        whole = days.where(~edge).withColumn("recent", F.col("day") > cut)
        edges = days.where(edge).select(key, "day", "_start", "_half")
        near = self.rows.join(edges, [key, "day"]).where(F.col(ts) >= F.col("_start"))
        order = Window.partitionBy(key).orderBy(ts)
        near = near.withColumn("_at", F.row_number().over(order))
        short = F.col("_at") <= LOOK_BACK
        # The k-th row of the windows has k - 1 rows before it.
        near = near.withColumns({c: F.when(~short | (F.col("_at") > k), F.col(c)) for k, c in enumerate(_LAGS, 1)})
        near = near.withColumns({"pm10_lag1": F.when(F.col("_at") > 1, F.col("pm10_lag1")), "_std": sample_std(["aqi", *_LAGS])})
        near = near.withColumn("aqi_roll_std4", F.when(short, F.col("_std")).otherwise(F.col("aqi_roll_std4")))
        by = [] if self.pooled else [key]
        parts = _moments(near.withColumn("recent", F.col(ts) >= F.col("_half")), [*by, "recent"], ts)
        columns = [c for c in parts.columns if c not in (*by, "recent")]
        return merge_moments(whole.select(*by, "recent", *columns).unionByName(parts.select(*by, "recent", *columns)), [*by, "recent"])

    def _both(self, values: dict[str, tuple[str, bool]]) -> DataFrame:
        """One row per group with both windows side by side, where there are enough rows."""

        def of(column: str | Column, recent: bool) -> Column:
            return F.max(F.when(F.col("recent") if recent else ~F.col("recent"), F.col(column) if isinstance(column, str) else column))

        sizes = [F.coalesce(of("rows", new), F.lit(0)).alias(name) for name, new in (("ref_rows", False), ("recent_rows", True))]
        grouped = self.windows_state().groupBy(*([] if self.pooled else [self.key]))
        return enough_rows(grouped.agg(*sizes, *[of(c, new).alias(name) for name, (c, new) in values.items()]))

    def features(self) -> DataFrame:
        """A8."""
        values = {}
        for f in DRIFT_FEATURES:
            std = F.sqrt(F.try_divide(F.col(f"m2_{f}"), F.when(F.col(f"n_{f}") > 1, F.col(f"n_{f}") - 1)))
            values |= {f"n_{f}": (f"n_{f}", False), f"mean_{f}": (f"mean_{f}", False), f"std_{f}": (std, False), f"new_{f}": (f"mean_{f}", True)}
        return shift_of_means(self._both(values), [] if self.pooled else [self.key], self.flag_above)

    def classes(self) -> DataFrame:
        """A9."""
        values = {"n_ref": ("classes", False), "n_new": ("classes", True)}
        for c in _LABELS:
            values |= {f"ref_{c}": (f"class_{c}", False), f"new_{c}": (f"class_{c}", True)}
        return self._both(values).selectExpr(*([] if self.pooled else [self.key]), class_percentages())

    def windows(self) -> DataFrame:
        """A11."""
        return self._both({"ref_from": ("first", False), "ref_to": ("last", False), "recent_from": ("first", True), "recent_to": ("last", True)})
