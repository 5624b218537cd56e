"""Neighbours inside a series (rows of one key in time order), safe for very long series.

A window partitioned by the key alone puts a whole series into one task. Where one key holds a large
part of all rows, such a series is cut at quantiles of its own times into pieces of about equally many
rows, whatever their pattern in time. Each piece gets the few rows just before and after it, and the window
runs per piece. The result is the same as that of the plain window, also for a null time (it comes first)
and for the rows without a key (a series like any other).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

# Rows of one series that one window task may hold.
MAX_SERIES_ROWS = 5_000_000
# Rows a side may have to be broadcast.
MAX_BROADCAST_ROWS = 100_000
# Times drawn per ``max_rows`` rows to find the quantiles.
_DRAWN = 128
# Bounds that one look at the heads skips.
_STRIDE = 256


@dataclass(frozen=True)
class Profile:
    """Row count, number of series and rows of the longest one."""

    rows: int
    series: int
    longest: int


def profile(df: DataFrame, key: str) -> Profile:
    """Count the series of a table: one job with map-side counts, three numbers to the driver."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    row = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))
    ).first()
    return Profile(*row)


def long_series(df: DataFrame, key: str, ts: str, max_rows: int = MAX_SERIES_ROWS) -> DataFrame:
    """One row ``(key, _bounds, _heads)`` per series with more than ``max_rows`` rows.

    ``_bounds`` are the times that cut it into pieces of about ``max_rows / 2`` rows, ``_heads`` is every
    ``_STRIDE``-th of them. They come from rows drawn by a digest of key and time, so computing them again
    gives the same cuts, and only about ``_DRAWN`` times per ``max_rows`` rows are gathered.
    """
    share = max(1, max_rows // _DRAWN)
    every = max(1, max_rows // (2 * share))
    drawn = F.when(F.pmod(F.xxhash64(key, ts), F.lit(share)) == 0, F.col(ts))
    times = df.groupBy(key).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(drawn)).alias("_at"))
    return (
        times.where(F.col("_n") > max_rows)
        .select(key, F.expr(f"filter(_at, (t, i) -> i % {every} = {every - 1})").alias("_bounds"))
        .withColumn("_heads", F.expr(f"filter(_bounds, (t, i) -> i % {_STRIDE} = 0)"))
    )


def _piece(ts: str) -> str:
    """Number of bounds up to a time: heads first, then the bounds behind the last head passed."""
    passed = f"size(filter(_heads, t -> t <= `{ts}`))"
    near = f"slice(_bounds, ({passed} - 1) * {_STRIDE} + 1, {_STRIDE})"
    found = f"({passed} - 1) * {_STRIDE} + size(filter({near}, t -> t <= `{ts}`))"
    return f"CASE WHEN _bounds IS NULL THEN NULL WHEN {passed} = 0 THEN 0 ELSE {found} END"


def over_series(
    df: DataFrame,
    key: str,
    ts: str,
    columns: Mapping[str, str | tuple[str, str]],
    back: int,
    ahead: int,
    stats: Profile | None = None,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows back and ``ahead`` rows ahead.

    ``columns`` maps a new name to a SQL window function such as ``lag(aqi, 1)``, or to a function and
    its frame. All of them share one exchange and one sort. ``(key, ts)`` must be unique.
    """
    stats = stats or profile(df, key)
    if stats.longest <= max_rows:
        return df.selectExpr("*", *_windowed(columns, [key], ts))

    cuts = long_series(df, key, ts, max_rows).withColumnRenamed(key, "_long")
    # Long series and their bounds number about two for ``max_rows`` rows; a larger list is left to the optimizer.
    if stats.rows // max_rows <= MAX_BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    rows = df.join(cuts, F.col(key).eqNullSafe(F.col("_long")), "left").withColumn("_cut", F.expr(_piece(ts)))
    rows = rows.drop("_long", "_bounds", "_heads")
    cut_rows = rows.where(F.col("_cut").isNotNull())
    borrowed = [
        _lend(cut_rows, key, ts, back, forward=True),
        _lend(cut_rows, key, ts, ahead, forward=False),
    ]
    whole = rows.withColumn("_lent", F.lit(False))
    for part in borrowed:
        if part is not None:
            whole = whole.unionByName(part)
    return (
        whole.selectExpr("*", *_windowed(columns, [key, "_cut"], ts))
        .where(~F.col("_lent"))
        .drop("_cut", "_lent")
    )


def _windowed(columns: Mapping[str, str | tuple[str, str]], keys: Sequence[str], ts: str) -> list[str]:
    window = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{ts}`"
    pairs = {name: (f, "") if isinstance(f, str) else f for name, f in columns.items()}
    return [f"{f} OVER ({window} {frame}) AS `{name}`" for name, (f, frame) in pairs.items()]


def _lend(rows: DataFrame, key: str, ts: str, n: int, forward: bool) -> DataFrame | None:
    """Copies of the border rows of each piece for the pieces that need them as neighbours.

    Going forward, the last ``n`` rows of a piece are wanted by every later piece with fewer than
    ``n`` rows in between. Among border rows alone those are the pieces of the next ``n`` rows, since
    a piece keeps up to ``n`` border rows. Going backward mirrors this with the first rows.
    """
    if n == 0:
        return None
    order = F.desc if forward else F.asc
    border = (
        rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_cut").orderBy(order(ts))))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
    # Only border rows meet here: n per piece of about max_rows / 2 rows.
    along = Window.partitionBy(key).orderBy(ts)
    step = F.lead if forward else F.lag
    near = F.array_distinct(F.array(*[step("_cut", i).over(along) for i in range(1, n + 1)]))
    return (
        border.withColumn("_near", near)
        .withColumn("_to", F.explode("_near"))
        .where(F.col("_to") != F.col("_cut"))
        .withColumn("_cut", F.col("_to"))
        .withColumn("_lent", F.lit(True))
        .drop("_near", "_to")
    )


def latest_per_key(df: DataFrame, key: str, ts: str, n: int, rank: str | None = None) -> DataFrame:
    """The last ``n`` rows of each series.

    The rank filter is applied before the exchange as well, so a task receives at most ``n`` rows per
    key from each map task. With ``rank`` the position from the end (1 = newest) is kept.
    """
    name = rank or "_rn"
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def with_key_values(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    n_keys: int | None = None,
    how: str = "inner",
    spread_by: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """Join one row per key to all rows of the key.

    Up to ``MAX_BROADCAST_ROWS`` keys the small side is broadcast. Beyond that both sides are spread
    over ``salts`` parts of each key, so that the rows of a frequent key go to many tasks. The part
    comes from the ``spread_by`` column, else from all columns.
    """
    if n_keys is None:
        n_keys = per_key.limit(MAX_BROADCAST_ROWS + 1).count()
    if n_keys <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(per_key), key, how)
    others = [spread_by] if spread_by else [c for c in rows.columns if c != key]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
