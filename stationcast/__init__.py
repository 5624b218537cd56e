"""stationcast: hourly station series, next-step class forecasts and their monitoring, on Spark."""

from stationcast.session import builder, tune, workspace

__all__ = ["builder", "tune", "workspace"]
