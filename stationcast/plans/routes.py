"""Read-side entry points over the stored tables (section 2.13 of the survey)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.operators import cleaning, metrics, scoring
from stationcast.operators.drift import Drift
from stationcast.operators.features import Medians
from stationcast.operators.joins import lookup
from stationcast.operators.scoring import Forecaster, persistence
from stationcast.plans.monitor import WINDOW_NAMES, warm, with_labels
from stationcast.schemas import UNKNOWN_ZONE
from stationcast.sinks.tables import last_snapshots
from stationcast.sources.dimensions import stations as default_stations
from stationcast.sources.tables import newest_time, read_silver

_DAYS = {name: days for days, (name, _, _) in WINDOW_NAMES.items()}


@dataclass(frozen=True)
class Routes:
    """Queries by station and pooled; each reads only the months and stations it needs."""

    spark: SparkSession
    silver_path: str
    forecast: Forecaster = persistence
    medians: Medians | None = None
    stations: DataFrame | None = None
    snapshots_path: str | None = None
    as_of: dt.datetime | None = None

    @cached_property
    def _stations(self) -> DataFrame:
        return default_stations(self.spark) if self.stations is None else self.stations

    @cached_property
    def _now(self) -> dt.datetime:
        return self.as_of or newest_time(self.spark, self.silver_path)

    def _readings(self, hours: float, slug: str | None = None) -> DataFrame:
        if slug is not None and self._stations.where(F.col("slug") == slug).isEmpty():
            raise ValueError(f"unknown station {slug!r}")
        return read_silver(self.spark, self.silver_path, hours, None if slug is None else [slug], self._now)

    def _known(self, hours: float) -> DataFrame:
        return cleaning.known_keys(self._readings(hours), self._stations, "city_slug", "slug")

    def cities(self) -> DataFrame:
        return self._stations.select("name", "slug", "lat", "lon", F.coalesce("timezone", F.lit(UNKNOWN_ZONE)).alias("timezone"))

    def predict(self, slug: str, hours: float = 340) -> DataFrame:
        """The latest forecast; no row when there are fewer than four readings."""
        made = scoring.latest_forecast(self._readings(hours, slug), self.forecast, self.medians)
        names = self._stations.select("slug", F.col("name").alias("city"), "timezone")
        return lookup(made, names, "city_slug", "slug", {"city": "—", "timezone": UNKNOWN_ZONE})

    def history(self, slug: str, hours: int = 48) -> DataFrame:
        if not 1 <= hours <= 168:
            raise ValueError(f"hours must be within 1..168, not {hours}")
        made = scoring.backtest(self._readings(hours + 4, slug), self.forecast, self.medians)
        return made.orderBy("timestamp")

    def drift(self, window: str = "1d", slug: str | None = None) -> dict[str, DataFrame]:
        """Drift of one station, or pooled over all of them."""
        if window not in _DAYS:
            raise ValueError(f"window must be one of {sorted(_DAYS)}, not {window!r}")
        days = _DAYS[window]
        rows = self._readings(2 * days * 24, slug) if slug is not None else self._known(2 * days * 24)
        found = Drift(rows, days, slug is None, self.forecast, self.medians)
        return {
            "features": found.features(),
            "classes": found.classes(),
            "predictions": found.predictions(),
            "windows": with_labels(found.windows(), days),
        }

    def model_metrics(self, hours: int = 168) -> dict[str, DataFrame]:
        if not 24 <= hours <= 168:
            raise ValueError(f"hours must be within 24..168, not {hours}")
        made = scoring.backtest(self._known(hours + 4), self.forecast, self.medians)
        return {"weighted": metrics.overall_scores(made), "per_class": metrics.per_class_scores(made)}

    def accuracy_trend(self, weeks: int = 8) -> dict[str, DataFrame]:
        if not 2 <= weeks <= 12:
            raise ValueError(f"weeks must be within 2..12, not {weeks}")
        readings = self._known(weeks * 168 + 4)
        daily = metrics.gated_trend(metrics.daily_accuracy(scoring.backtest(readings, self.forecast, self.medians)), readings)
        return {"trend": daily.orderBy("day"), "summary": metrics.accuracy_summary(daily)}

    def feature_importance(self) -> DataFrame:
        """The newest snapshot."""
        return last_snapshots(self._snapshots(), 1)

    def feature_importance_history(self) -> DataFrame:
        return last_snapshots(self._snapshots())

    def _snapshots(self) -> DataFrame:
        if self.snapshots_path is None:
            raise ValueError("no snapshots_path given")
        return self.spark.read.parquet(self.snapshots_path)

    def warm_tables(self, out_path: str, gold_path: str | None = None) -> DataFrame:
        return warm(
            self.spark, self.silver_path, out_path, self.forecast, self.medians, self._stations, self._now,
            gold_path=gold_path,
        )
