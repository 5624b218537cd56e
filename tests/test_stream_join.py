"""The join of two streams against the batch join, whichever side comes first."""

import pytest
from conftest import at, reading
from pyspark.sql import functions as F

from stationcast.operators import joins
from stationcast.schemas import PREDICTION, READING
from stationcast.streaming.joins import predicted_vs_actual_stream, write_joined

FAR = 24 * 365


def forecasts(spark):
    rows = []
    for s in ("a", "b"):
        for h in range(30):
            for before in (3, 1, 2):
                rows.append((at(h), s, (h + before) % 5 + 1, before / 8, at(h - before)))
    rows += [(at(99), "a", 1, 0.5, at(98)), (at(8), "a", 5, 0.25, at(7)), (at(8), "a", 5, 0.5, at(7)), (at(9), "b", None, None, at(8))]
    return spark.createDataFrame([tuple({"forecast_for": r[0], "city_slug": r[1], "predicted": r[2], "confidence": r[3], "as_of": r[4]}[f] for f in PREDICTION.fieldNames()) for r in rows], PREDICTION)


@pytest.mark.parametrize("first", ["predictions", "readings", "both"])
def test_stream_join_equals_the_batch_join(spark, frame, tmp_path, first):
    made = forecasts(spark)
    # Readings of some hours are missing, some come again.
    known = frame([reading(s, h, h % 5 + 1) for s in ("a", "b") for h in range(0, 30) if h % 7])
    want = sorted(joins.predicted_vs_actual(made, known).collect())
    land = {n: str(tmp_path / n) for n in ("predictions", "readings")}
    # One row of each stream far ahead moves the watermarks.
    ahead = {"predictions": made.limit(1).withColumn("forecast_for", F.lit(at(FAR))), "readings": frame([reading("z", FAR, 1)])}
    whole = {"predictions": made, "readings": known.unionByName(known.limit(5))}
    for n, path in land.items():
        whole[n].limit(0).write.parquet(path)

    def run():
        sides = {n: spark.readStream.schema(s).parquet(land[n]) for n, s in (("predictions", PREDICTION), ("readings", READING))}
        query = write_joined(predicted_vs_actual_stream(**sides), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query.lastProgress

    order = [first, *[n for n in land if n != first]] if first != "both" else []
    for n in order:
        whole[n].write.mode("append").parquet(land[n])
        run()
    if not order:
        for n in land:
            whole[n].write.mode("append").parquet(land[n])
    for n in land:
        ahead[n].write.mode("append").parquet(land[n])
    last = run()
    found = sorted(spark.read.parquet(str(tmp_path / "out")).collect())
    assert [tuple(r) for r in found] == [tuple(r) for r in want] and len(want) == 50
    # Only the rows far ahead are left in the state.
    assert sum(s.numRowsTotal for s in last.stateOperators) <= 4
