"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stationcast.session import workspace

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that one Python worker keeps between tasks, made on first use."""
    kept = sys.modules.setdefault("stationcast_worker_state", types.ModuleType("stationcast_worker_state"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, lost executors cost nothing."""
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# 64-bit words of a key filter: 2 MB of bits, at most this many rows to broadcast, whatever the table.
FILTER_WORDS = 1 << 18


def _bit(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(64 * FILTER_WORDS))


def key_filter(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """(slot, bits): a bit map of bounded size with the bit of every row of ``keys`` set."""
    bits = keys.select(_bit(*keys.columns).alias("bit")).selectExpr("bit >> 6 AS slot", "shiftleft(1L, CAST(bit & 63 AS INT)) AS one")
    return stored(spark, bits.groupBy("slot").agg(F.bit_or("one").alias("bits")), "filter")


def may_hold(rows: DataFrame, key: list[str], slots: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``may_hold``: false only where ``key`` is surely not among the keys of ``slots``.

    Rows are not exchanged. The filter only spares work: where it is full, every row may be held, and the
    exact join that follows decides.
    """
    at = rows.withColumn("filter_bit", _bit(*key)).withColumn("filter_slot", F.expr("filter_bit >> 6"))
    found = at.join(F.broadcast(slots), F.col("filter_slot") == F.col("slot"), "left")
    hit = F.expr("coalesce(bits & shiftleft(1L, CAST(filter_bit & 63 AS INT)), 0L) != 0")
    return found.withColumn("may_hold", hit).drop("filter_bit", "filter_slot", "slot", "bits")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def flat_text(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch with null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def sums_per_list(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run ``values[offsets[i]:offsets[i + 1]]``; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def offsets_of(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list array into its own flattened values, starting at 0."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def share(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
