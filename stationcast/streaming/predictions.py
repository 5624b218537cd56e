"""Buffered prediction lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stationcast.sinks.tables import append_predictions
from stationcast.sources.responses import parse_predictions


def prediction_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def drain(
    lines: DataFrame, gold_path: str, rejects_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append good lines to gold and keep bad ones aside.

    Nothing is deleted from the landing folder, the checkpoint remembers what was read. A batch that
    is run again adds no forecast twice and replaces its own rejects.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            good, bad = parse_predictions(rows)
            append_predictions(batch.sparkSession, good, gold_path)
            (
                bad.withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(rejects_path)
            )
        finally:
            rows.unpersist()

    return (
        lines.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
