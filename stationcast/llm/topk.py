"""Exact top-k search by inner product over integer vectors, pruned with multi-resolution segment statistics.

For a segment of m components with mean u and deviation s (population), the inner product of two segments is
at most m * (u1 * u2 + s1 * s2); equally, their squared distance is at least m * ((u1 - u2)**2 + (s1 - s2)**2),
since |a - b|**2 = |a|**2 + |b|**2 - 2 a.b. The bound over all segments is the inner product of two short
feature vectors, and it tightens with the number of segments.

Queries and rows are dealt into cells of a grid (query block, row block), each of bounded size. In a cell
the coarsest bounds of all pairs pick likely neighbours, whose exact scores set a threshold per query; pairs
whose bound is below it go, coarse to fine, and the survivors get their exact integer score. The finest level
has half as many bound features as a vector of 64 has components. The first row block is searched before the
others: the k-th best score a query has there is its least threshold in all other cells. A cell keeps the k
best rows of each of its queries, and a last window keeps the k best of all cells. Every row is compared or
ruled out by a bound, so the result is exact.

Vectors that are null or hold a null or non-finite component take no part; vectors are only compared with
vectors of the same length. Repeated (id, vector) rows count once. Ties go to the smaller id. Ids are not
null. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stationcast.llm.common import stored

QUERY_BLOCK = 1024
ROW_BLOCK = 8192
LEVELS = (4, 8, 16)
CHUNK = 64
# Up to this share of surviving pairs a level works on the pairs, above it on the whole block.
SPARSE = 0.02


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component of the usable vectors."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    return rows.where(finite).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()


def segment_features(m: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): mean and deviation of each segment, both times the root of its length."""
    edges = np.linspace(0, m.shape[1], min(segments, max(1, m.shape[1])) + 1).astype(int)
    parts = [m[:, a:b] for a, b in zip(edges, edges[1:]) if b > a]
    if not parts:
        return np.zeros((len(m), 1))
    return np.stack([f(p, axis=1) * np.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)], axis=1)


def _threshold(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` rows of each query reach: the k-th best among the rows with the largest bounds."""
    likely = min(2 * k, len(rows))
    if likely < k:
        return np.full(len(queries), -np.inf)
    top = np.argpartition(-bound, likely - 1, axis=1)[:, :likely]
    scores = np.einsum("qd,qnd->qn", queries, rows[top]).astype(float)
    scores[np.isneginf(np.take_along_axis(bound, top, axis=1))] = -np.inf
    return -np.sort(-scores, axis=1)[:, k - 1]


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of all queries with all rows; in doubles where those hold every partial sum."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if largest < 2**53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def _products(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, ri: np.ndarray, dtype) -> np.ndarray:
    """Inner product of each listed pair, in steps of bounded memory."""
    out = np.empty(len(qi), dtype)
    for a in range(0, len(qi), 1 << 17):
        i, j = qi[a : a + (1 << 17)], ri[a : a + (1 << 17)]
        out[a : a + len(i)] = np.einsum("nd,nd->n", queries[i], rows[j])
    return out


def best_in_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, levels=LEVELS, known: np.ndarray | None = None
):
    """(query position, row position, score) of the k best rows per query, the query's own id left out.

    ``known`` holds a score per query that k rows elsewhere are known to reach: lower scores are left out.
    """
    exact_q, exact_r = queries.astype(np.int64), rows.astype(np.int64)
    known = np.full(len(queries), -np.inf) if known is None else known
    q_feat = [segment_features(queries.astype(float), n) for n in levels]
    r_feat = [segment_features(rows.astype(float), n) for n in levels]
    # Rounding of the bounds, relative to the largest norms in the block.
    slack = 1e-9 * (1 + np.sqrt((queries.astype(float) ** 2).sum(axis=1)).max(initial=0) * np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max(initial=0))
    found = []
    for start in range(0, len(queries), CHUNK):
        q = np.arange(start, min(start + CHUNK, len(queries)))
        alive = query_ids[q][:, None] != row_ids[None, :]
        least, qi, ri = known[q].astype(float), None, None
        for fq, fr in zip(q_feat, r_feat):
            if qi is None:
                bound = np.where(alive, fq[q] @ fr.T, -np.inf)
                least = np.maximum(least, _threshold(exact_q[q], exact_r, bound, k))
                alive &= bound >= least[:, None] - slack
                if alive.mean() <= SPARSE:
                    qi, ri = np.nonzero(alive)
            else:
                ok = _products(fq[q], fr, qi, ri, float) >= least[qi] - slack
                qi, ri = qi[ok], ri[ok]
        if qi is None:
            # Many survivors: exact scores of the rows that survive for any query, then of the surviving pairs only.
            some = np.flatnonzero(alive.any(axis=0))
            all_scores = _exact(exact_q[q], exact_r[some])
            qi, at = np.nonzero(alive[:, some] & (all_scores >= least[:, None] - slack))
            ri, score = some[at], all_scores[qi, at]
        else:
            score = _products(exact_q[q], exact_r, qi, ri, np.int64)
            ok = score >= least[qi] - slack
            qi, ri, score = qi[ok], ri[ok], score[ok]
        order = np.lexsort((row_ids[ri], -score, qi))
        qi, ri, score = qi[order], ri[order], score[order]
        first = np.searchsorted(qi, qi)
        best = np.arange(len(qi)) - first < k
        found.append((q[qi[best]], ri[best], score[best]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, int)] * 3


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    values = table.column("v").combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return ids, values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``df`` that ``is_query`` (over column ``id``) selects."""
    vectors = integer_vectors(df, id_col, vec_col, scale)
    counts = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts.n // ROW_BLOCK)), max(1, -(-counts.q // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumn("dims", F.size("v"))
    cells = ["dims", "qb", "rb"]
    asked = rows.where(is_query).withColumn("qb", block(query_blocks))
    dealt = rows.withColumn("rb", block(row_blocks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        (query_ids, queries), (row_ids, vecs) = _matrix(left), _matrix(right)
        known = left.column("least").to_numpy()
        qi, ri, score = best_in_block(queries, query_ids, vecs, row_ids, k, known=known)
        return pa.table([pa.array(query_ids[qi]), pa.array(row_ids[ri]), pa.array(score)], names)

    def in_cells(queries: DataFrame, first: int, last: int) -> DataFrame:
        left = queries.withColumn("rb", F.explode(F.sequence(F.lit(first), F.lit(last))))
        left = left.select(*[F.col(c).alias(c) for c in ("id", "v", "least", *cells)])
        right = dealt.where(F.col("rb").between(first, last)).withColumn("qb", every(query_blocks))
        return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = in_cells(asked.withColumn("least", F.lit(float("-inf"))), 0, 0)
    if row_blocks > 1:
        best = stored(df.sparkSession, best, "first_block")
        nth = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        reached = nth.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
        others = asked.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        best = best.unionByName(in_cells(others, 1, row_blocks - 1))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
