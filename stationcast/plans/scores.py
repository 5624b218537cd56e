"""Silver and its scores moved on together, batch by batch."""

from __future__ import annotations

import re
from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.functions import clamp_class
from stationcast.operators.features import Medians, readable
from stationcast.operators.increments import merged_cells, signed_changes
from stationcast.operators.scoring import Forecaster, persistence
from stationcast.operators.series import MAX_BROADCAST_ROWS, Profile, profile
from stationcast.operators.upsert import table_or_none, upsert, upsert_table
from stationcast.schemas import READING, SILVER
from stationcast.sinks.files import children, exists
from stationcast.sources.tables import read_silver

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class ScoreLog:
    """Signed changes of the cells, one folder per batch, and from time to time their sum.

    A batch's changes are written once, before silver takes the batch: found complete they are left alone, so a batch
    that is run again, wherever it stopped, counts once. ``fold`` writes the sum of all complete batches with the list of
    their names; that list is written last and makes the sum valid. Readers take the newest valid sum and the
    batches it does not name, so nothing has to be deleted for a right result.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "city_slug"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _folder(self, batch: str) -> str:
        if not _NAME.fullmatch(batch):
            raise ValueError(f"a batch name has letters, digits, dots, dashes and underscores, not {batch!r}")
        return f"{self.path}/changes/{batch}"

    def holds(self, batch: str) -> bool:
        return exists(self.spark, f"{self._folder(batch)}/_SUCCESS")

    def write(self, batch: str, changes: DataFrame) -> None:
        """The changes of a batch, unless they are there already."""
        if not self.holds(batch):
            changes.write.mode("overwrite").parquet(self._folder(batch))

    def _batches(self) -> list[str]:
        return sorted(b for b in children(self.spark, f"{self.path}/changes") if self.holds(b))

    def _sum(self) -> tuple[int, DataFrame | None, set[str]]:
        """Number, rows and batches of the newest valid sum."""
        numbers = sorted((int(n) for n in children(self.spark, f"{self.path}/sums") if n.isdigit()), reverse=True)
        for n in numbers:
            if exists(self.spark, f"{self.path}/sums/{n}/batches/_SUCCESS"):
                # A name per batch since the log began.
                names = {r.batch for r in self.spark.read.parquet(f"{self.path}/sums/{n}/batches").collect()}
                return n, self.spark.read.parquet(f"{self.path}/sums/{n}/cells"), names
        return 0, None, set()

    def cells(self) -> DataFrame | None:
        """The state: None before the first batch."""
        _, base, folded = self._sum()
        open_ = [self._folder(b) for b in self._batches() if b not in folded]
        parts = ([base] if base is not None else []) + ([self.spark.read.parquet(*open_)] if open_ else [])
        return merged_cells(parts, self.key) if parts else None

    def fold(self) -> None:
        """Write the sum of all complete batches, so that readers open few files."""
        n, _, folded = self._sum()
        batches = self._batches()
        if set(batches) == folded:
            return
        at = f"{self.path}/sums/{n + 1}"
        self.cells().write.mode("overwrite").parquet(f"{at}/cells")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")


def merge_and_score(
    spark: SparkSession, silver_path: str, log: ScoreLog, batch: str, readings: DataFrame, forecast: Forecaster = persistence,
    medians: Medians | None = None,
) -> None:
    """Upsert a batch of readings into silver and its effect on the cells into the log.

    ``readings`` has the columns of a reading and must give the same rows if the batch is run again. A batch without rows
    leaves an empty entry.
    """
    rows = readings.select(*[F.col(f.name).cast(f.dataType) for f in READING.fields]).where("city_slug is not null and timestamp is not null")
    if not log.holds(batch):
        before = None
        sizes = [profile(rows, log.key)]
        if table_or_none(spark, silver_path, SILVER) is not None:
            before = read_silver(spark, silver_path, clamp=False).select(*READING.fieldNames())
            sizes.append(profile(before, log.key))
            keys = rows.select(log.key).distinct()
            before = before.join(F.broadcast(keys) if sizes[0].series <= MAX_BROADCAST_ROWS else keys, log.key, "left_semi")
        # Only touched series are merged here, and once: the rows say what they were.
        after = readable(upsert(before if before is not None else rows.limit(0), rows, trace=True)).withColumn("_was_aqi", clamp_class("_was_aqi"))
        most = Profile(*(sum(x) for x in zip(*map(astuple, sizes))))
        changes = signed_changes(before, after, rows, forecast, medians, log.key, stats=most)
        log.write(batch, changes)
    upsert_table(spark, silver_path, rows, SILVER)
