"""Whitening of embeddings with a covariance found by polarisation.

Every component c becomes the integer x = floor(scale * c) + shift. For each dimension, and for the sum of each
pair of dimensions, the squares of the centred values are added up exactly, in integers. A pair's covariance
is half of the variance of the sum less the two single variances, so squared sums alone give the whole
covariance matrix; it is assembled for an eigendecomposition, and each vector is projected on the leading unit
eigenvectors and divided by the root of their eigenvalues.

Values are centred in two exact steps: by the integer nearest to the mean before they are squared, which keeps
the squares small, and by what is left of the mean in the totals. The first rounding is that of the finished
covariance to a double.

The driver holds sums per dimension and pair: it depends on the length of a vector, never on how many there are.

A row takes part if its vector is not null, has no null or non-finite component, none whose scaled value reaches
2**40, and the length that most such rows have (the longer one on a tie). Repeated rows and ids count and are
returned as often as they occur; a null id stays null. Components whose eigenvalue is no more than 1e-12 of the
trace have no direction to scale and are left out, so equal vectors, a single one or an empty table give no rows.
A deviation beyond a long is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LARGEST = float(1 << 40)
LEAST_SHARE = 1e-12
_EXACT = pa.decimal128(38, 0)
_SUMS = "i int, j int, s decimal(38,0)"


class Fit(NamedTuple):
    n: int
    sums: list[int]  # of x
    centre: list[int]  # the integers nearest to the means
    left: list[int]  # sums of x - centre
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors in columns


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the usable vectors as integers."""
    c = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    usable = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & usable)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * scale) + shift).alias("x"))


def _block(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _wide(z: np.ndarray, least_bits: int) -> np.ndarray:
    """``z`` as Python integers where its squares might leave 64 bits."""
    return z.astype(object) if z.size and int(np.abs(z).max()).bit_length() > least_bits else z


def _exact_rows(parts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, s = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in s], _EXACT)], ["i", "j", "s"])


def _summed(rows: DataFrame, task, schema: str) -> list:
    """The totals of every task's sums; ``task`` adds up its own batches first."""
    return rows.mapInArrow(task, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()


def fit(rows: DataFrame) -> tuple[DataFrame, Fit | None]:
    """The rows of the usual length, and their moments; None if there are none."""
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return rows.limit(0), None
    dims, n = length.d, length.n
    rows = rows.where(F.size("x") == dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            total = [a + int(b) for a, b in zip(total, _block(batch, dims).sum(axis=0))]
        yield _exact_rows([(d, d, s) for d, s in enumerate(total)])

    found = {r.i: int(r.s) for r in _summed(rows, sums, _SUMS)}
    total = [found[d] for d in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    left = [s - n * c for s, c in zip(total, centre)]
    middle = np.array(centre, np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            # 22 bits: the square of a sum of two values stays below 2**46, a batch of them below 2**63.
            z = _wide(_block(batch, dims) - middle, 22)
            for d in range(dims):
                alone = (z[:, d] * z[:, d]).sum()
                pairs = ((z[:, d + 1 :] + z[:, d : d + 1]) ** 2).sum(axis=0)
                for e, s in enumerate([alone, *pairs], d):
                    total[d, e] = total.get((d, e), 0) + int(s)
        yield _exact_rows([(d, e, s) for (d, e), s in total.items()])

    squared = {(r.i, r.j): int(r.s) for r in _summed(rows, squares, _SUMS)}
    single = [n * squared[d, d] - left[d] ** 2 for d in range(dims)]
    covariance = np.empty((dims, dims))
    for d in range(dims):
        covariance[d, d] = single[d] / n**2
        for e in range(d + 1, dims):
            both = n * squared[d, e] - (left[d] + left[e]) ** 2
            covariance[d, e] = covariance[e, d] = (both - single[d] - single[e]) / (2 * n**2)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(dims)] < 0, -1.0, 1.0)
    return rows, Fit(n, total, centre, left, covariance, values, vectors)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for rows of ``integers``."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    rows, found = fit(rows)
    trace = float(np.trace(found.covariance)) if found else 0.0
    kept = int((found.values[:components] > LEAST_SHARE * trace).sum()) if found else 0
    if not kept:
        return rows.sparkSession.createDataFrame([], schema + ", identity_error double")
    n, dims = found.n, len(found.sums)
    values, basis = found.values[:kept], found.vectors[:, :kept] / np.sqrt(found.values[:kept])
    middle, rest = np.array(found.centre, np.int64), np.array([s / n for s in found.left])

    def white(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = _block(batch, dims) - middle
        return z, (z - rest) @ basis

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, alone = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            w = white(batch)[1]
            total, alone = total + w.T @ w, alone + w.sum(axis=0)
        i, j = np.indices((kept, kept)).reshape(2, -1).astype(np.int32)
        single = np.arange(kept, dtype=np.int32)
        cells = [np.concatenate(x) for x in ((i, np.full(kept, -1, np.int32)), (j, single), (total.ravel(), alone))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["i", "j", "s"])

    measured, means = np.zeros((kept, kept)), np.zeros(kept)
    for r in _summed(rows, products, "i int, j int, s double"):
        if r.i < 0:
            means[r.j] = r.s / n
        else:
            measured[r.i, r.j] = r.s / n
    error = float(np.abs(measured - np.outer(means, means) - np.eye(kept)).max())
    left, explained = np.array(found.left, object), values / trace
    bits = n.bit_length() + 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, w = white(batch)
            m = batch.num_rows
            # y = n * x - S, exactly; its squares over all dimensions have to stay within 64 bits.
            wide = _wide(z, (62 - dims.bit_length()) // 2 - bits)
            y = wide * n - (left if wide.dtype == object else left.astype(np.int64))
            deviation = pa.array([v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n, np.int64)),
                    deviation.take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))
