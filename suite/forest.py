"""A small forest, written out node by node, for queries and their SQL."""

from __future__ import annotations

from stationcast.schemas import FEATURES

# tree, node, feature, threshold, left, right, gain, rows of classes 1-5.
_NODES = [
    (0, 0, "pm10", 120.0, 1, 2, 0.31, (40, 30, 10, 12, 8)),
    (0, 1, "aqi_delta_1h", 0.5, 3, 4, 0.12, (30, 12, 4, 4, 2)),
    (0, 2, "co", 260.0, 5, 6, 0.22, (10, 18, 6, 8, 6)),
    (0, 3, None, None, -1, -1, None, (24, 6, 2, 2, 1)),
    (0, 4, None, None, -1, -1, None, (6, 6, 2, 2, 1)),
    (0, 5, "aqi_roll_std4", 1.25, 7, 8, 0.05, (8, 10, 2, 3, 3)),
    (0, 6, None, None, -1, -1, None, (2, 8, 4, 5, 3)),
    (0, 7, None, None, -1, -1, None, (7, 4, 1, 1, 1)),
    (0, 8, None, None, -1, -1, None, (1, 6, 1, 2, 2)),
    (1, 0, "hour_sin", 0.0, 10, 20, 0.09, (20, 20, 20, 20, 20)),
    (1, 10, "o3", 55.0, 11, 12, 0.27, (12, 9, 14, 7, 6)),
    (1, 11, None, None, -1, -1, None, (11, 3, 2, 1, 0)),
    (1, 12, None, None, -1, -1, None, (1, 6, 12, 6, 6)),
    (1, 20, "pm25_ratio", 0.4, 21, 22, 0.18, (8, 11, 6, 13, 14)),
    (1, 21, None, None, -1, -1, None, (7, 2, 3, 3, 2)),
    (1, 22, None, None, -1, -1, None, (1, 9, 3, 10, 12)),
    (5, 0, None, None, -1, -1, None, (5, 6, 7, 8, 9)),
]


def rows() -> list[tuple]:
    """The nodes with features by position."""
    return [(t, n, -1 if f is None else FEATURES.index(f), x, a, b, g, [float(c) for c in k]) for t, n, f, x, a, b, g, k in _NODES]


def values_sql() -> str:
    """The same as a SQL relation; features by position from 1, leaf shares as a list."""
    lines = []
    for t, n, f, x, a, b, g, k in rows():
        shares = ", ".join(f"{c!r}::DOUBLE / {sum(k)!r}" for c in k)
        lines.append(f"({t}, {n}, {f + 1}, {'NULL' if x is None else x}::DOUBLE, {a}, {b}, {'NULL' if g is None else g}::DOUBLE, [{shares}])")
    return "nodes(tree, node, feature, threshold, l, r, gain, shares) AS (VALUES " + ",\n".join(lines) + ")"
