"""Exact medians of many columns in bounded memory (A1)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

_BINS = 4096
_SKETCH = 1000


def median_values(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The median of every column; nulls skipped, an even count averages the middle two.

    The built-in exact ``median`` keeps all distinct values of a column in one task. Here three passes
    narrow it down instead: a sketch brackets the middle, a histogram of the bracket (with one outer
    bin on each side) tells which bin holds the middle rows, and only the values of that bin are
    counted one by one. The sketch only has to be near: the bin is found by counting, whichever it is.
    A few numbers per column come to the driver after each pass. A table that is costly to compute is
    best written first.
    """
    ends = df.selectExpr(
        *[f"percentile_approx({as_number(c)}, array(0.497, 0.503), {_SKETCH}) AS e{i}" for i, c in enumerate(columns)],
        *[f"count({as_number(c)}) AS n{i}" for i, c in enumerate(columns)],
    ).first()
    return bracketed_medians(df, {c: tuple(ends[f"e{i}"]) for i, c in enumerate(columns) if ends[f"n{i}"] > 0})


def bracketed_medians(df: DataFrame, around: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The exact median of every column from a guess (low, high) of where it lies; columns without a value are left out.

    The guess decides how much the last pass has to count one by one, never the result.
    """
    if not around:
        return {}
    columns, brackets = list(around), list(around.values())
    long = df.selectExpr(f"posexplode(array({', '.join(map(as_number, columns))})) AS (i, value)").where("value IS NOT NULL")
    binned = long.selectExpr("i", "value", f"{_bin(brackets)} AS bin")
    total = "sum(n) OVER (PARTITION BY i) AS total"
    middle = "explode(array_distinct(array((total - 1) DIV 2, total DIV 2))) AS rank"
    here = "before <= rank AND rank < before + n"

    hits = (
        binned.groupBy("i", "bin")
        .agg(F.count("*").alias("n"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY i ORDER BY bin) - n AS before", total)
        .selectExpr("*", middle)
        .where(here)
        .select("i", "bin", "before", "rank")
        .collect()
    )
    if not hits:
        return {}
    # Bin -2 does not occur: a column without values finds none.
    ranks = [sorted({h.rank for h in hits if h.i == i}) or [0] for i in range(len(columns))]
    found = [sorted({(h.bin, h.before) for h in hits if h.i == i}) or [(-2, 0)] for i in range(len(columns))]
    bins, before = [[b for b, _ in f] for f in found], [[n for _, n in f] for f in found]
    asked = f"explode({_nested(ranks, 'BIGINT')}[i]) AS rank"
    place = f"CAST(array_position({_nested(bins, 'INT')}[i], bin) AS INT)"
    # The window sees the distinct values of one narrow bin.
    rows = (
        binned.where(f"{place} > 0")
        .groupBy("i", "bin", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.expr(f"element_at({_nested(before, 'BIGINT')}[i], {place})"))
        .selectExpr("*", "start + sum(n) OVER (PARTITION BY i, bin ORDER BY value) - n AS before")
        .selectExpr("*", asked)
        .where(here)
        .groupBy("i")
        .agg(F.avg("value").alias("median"))
        .collect()
    )
    return {columns[r.i]: r.median for r in rows}


def as_number(c: str) -> str:
    return f"nanvl(CAST(`{c}` AS DOUBLE), NULL)"


def _nested(lists: list[list[int]], kind: str) -> str:
    """A constant array of arrays, looked up by position."""
    inner = ", ".join(f"array({', '.join(f'CAST({v} AS {kind})' for v in values)})" for values in lists)
    return f"array({inner})"


def _bin(brackets: list[list[float]]) -> str:
    """Position of a value in its column's bracket: -1 below, ``_BINS`` above, rising with the value."""

    def constants(values):
        return f"array({', '.join(f'double({v!r})' for v in map(repr, values))})[i]"

    widths = [(hi - lo) / _BINS for lo, hi in brackets]
    widths = [w if 0 < w < math.inf else math.inf for w in widths]
    low, high = constants(lo for lo, _ in brackets), constants(hi for _, hi in brackets)
    width = constants(widths)
    return (
        f"CASE WHEN value < {low} THEN -1 WHEN value > {high} THEN {_BINS} WHEN {width} = double('inf') THEN 0 "
        f"ELSE CAST(least(floor((value - {low}) / {width}), {_BINS - 1}) AS INT) END"
    )


def approximate_medians(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """One pass, rank error at most ``1/accuracy``: for runs where the exact value does not matter."""
    return df.selectExpr(*[f"percentile_approx({as_number(c)}, 0.5, {accuracy}) AS `{c}`" for c in columns])
