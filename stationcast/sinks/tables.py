"""Writers for bronze, silver, gold and snapshots (K1-K5, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.functions import year_month
from stationcast.operators.cleaning import dedup_keep_first
from stationcast.operators.upsert import KEYS, in_partitions, table_or_none, touched, upsert_table, write_months
from stationcast.schemas import BRONZE_HOURLY, GOLD, PREDICTION, SILVER
from stationcast.sinks.files import exists
from stationcast.sinks.folders import local_path, write_new


def write_bulk(df: DataFrame, path: str) -> None:
    """Bulk bronze by station, year and month (K1). Running it again replaces the months it holds.

    There is a folder for every station and month, so what each folder costs counts. A new table is written without
    the swap of single folders that replacing months takes and that the driver does alone, and in a local file system
    also without Hadoop's processes for every file and folder.
    """
    parts = ["city_slug", "year", "month"]
    rows = df.withColumn("year", F.date_format("timestamp", "yyyy")).withColumn("month", F.date_format("timestamp", "MM"))
    spark = df.sparkSession
    new = not exists(spark, path)
    if new and (local := local_path(spark, path)):
        write_new(rows, parts, ["timestamp"], local)
        return
    writer = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, "timestamp").write.partitionBy(*parts)
    if new:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_hourly(spark: SparkSession, df: DataFrame, path: str, at: str = "timestamp") -> None:
    """Hourly bronze in zero-padded ``year=/month=/day=`` folders (K2).

    The hours of each station in the batch are replaced, so an hour that is delivered again does not double;
    other hours of the same days and other stations of the same hour are kept.
    """
    formats = {"year": "yyyy", "month": "MM", "day": "dd"}
    columns = [f.name for f in BRONZE_HOURLY.fields if f.name not in formats]
    rows = df.select(*columns).withColumns({name: F.date_format(at, f) for name, f in formats.items()})
    existing = table_or_none(spark, path, BRONZE_HOURLY)
    if existing is not None:
        hours = rows.select("city_slug", F.date_trunc("HOUR", at).alias("_hour")).distinct()
        days = touched(rows.select(F.concat(*formats).alias("_day")), "_day")
        among = existing.where(F.concat(*formats).isin([d for d in days if d is not None]))
        kept = among.withColumn("_hour", F.date_trunc("HOUR", at))
        rows = rows.unionByName(kept.join(hours, ["city_slug", "_hour"], "left_anti").select(*rows.columns))
    (
        rows.hint("rebalance", *formats)
        .sortWithinPartitions(*formats, "city_slug", at)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*formats)
        .parquet(path)
    )


def seed_silver(spark: SparkSession, clean: DataFrame, path: str) -> None:
    """Fill silver from cleaned bulk readings, whose keys are unique (K3): an upsert, so it can be repeated."""
    upsert_table(spark, path, clean, SILVER, unique=True)


def append_predictions(
    spark: SparkSession, predictions: DataFrame, path: str, keys: tuple[str, ...] = ("city_slug", "forecast_for", "as_of")
) -> None:
    """Append forecasts that are not in gold yet (K5).

    Keyed by station, forecast hour and the moment the forecast was made from: every hour that was forecast at
    one moment is kept, and a replayed batch adds nothing.
    """
    columns = PREDICTION.fieldNames()
    rows = predictions.select(*columns).withColumn("confidence", F.bround("confidence", 6))
    batch = dedup_keep_first(rows, list(keys), columns).withColumn("ym", year_month("forecast_for"))
    existing = table_or_none(spark, path, GOLD)
    if existing is not None:
        months = touched(batch, "ym")
        batch = batch.join(in_partitions(existing, "ym", months).select(*keys), list(keys), "left_anti")
    batch.hint("rebalance", "ym").write.mode("append").partitionBy("ym").parquet(path)


def append_snapshot(importances: DataFrame, path: str, computed_at: str) -> None:
    """Store the importances of one fit (K8). Storing the same fit again replaces it."""
    (
        importances.withColumn("computed_at", F.lit(computed_at))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("computed_at")
        .parquet(path)
    )


def last_snapshots(snapshots: DataFrame, keep: int = 30) -> DataFrame:
    """The newest ``keep`` snapshots; older ones are not shown (K8)."""
    newest = snapshots.select("computed_at").distinct().orderBy(F.desc("computed_at")).limit(keep)
    return snapshots.join(F.broadcast(newest), "computed_at", "left_semi")


__all__ = [
    "KEYS",
    "append_predictions",
    "append_snapshot",
    "last_snapshots",
    "seed_silver",
    "upsert_table",
    "write_bulk",
    "write_hourly",
    "write_months",
]
