"""Column expressions. All of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stationcast.schemas import RATIO_EPSILON

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_nan(c: ColumnLike) -> Column:
    """NaN counts as missing."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def half_even(c: ColumnLike, digits: int) -> Column:
    """Round with ties to the even digit (H8)."""
    return F.bround(_col(c), digits)


def settled(c: ColumnLike, digits: int) -> Column:
    """The same for a mean or sum whose last bits depend on the order of addition.

    Values are added up in a different order in every run, so one that sits on a tie could fall either
    way; five more digits are settled first.
    """
    return F.bround(F.round(_col(c), digits + 5), digits)


def cyclic(expression: str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle of the given length, from a SQL expression (H4)."""
    angle = f"({expression}) * {2 * math.pi / period!r}D"
    return F.expr(f"sin({angle})"), F.expr(f"cos({angle})")


def to_class(c: ColumnLike) -> Column:
    """Text or number to a whole class; ties go to the even number, bad values become null."""
    return F.bround(drop_nan(_col(c).try_cast("double"))).cast("int")


def clamp_class(c: ColumnLike, lowest: int | None = None, highest: int = 5) -> Column:
    """Cut a class to the valid range (P5). ``least`` and ``greatest`` skip nulls, so guard them."""
    value = _col(c)
    cut = F.least(value, F.lit(highest))
    if lowest is not None:
        cut = F.greatest(cut, F.lit(lowest))
    return F.when(value.isNotNull(), cut.cast("int"))


def share_of_total(part: str, others: Sequence[str], nulls: str = "zero") -> Column:
    """``part / (part + others)`` over named columns (H7).

    ``nulls='zero'`` counts a missing other as 0; ``nulls='null'`` makes the share null. A missing
    part gives null in both.
    """
    if nulls not in ("zero", "null"):
        raise ValueError(f"nulls must be 'zero' or 'null', not {nulls!r}")
    form = "coalesce(`{}`, 0D)" if nulls == "zero" else "`{}`"
    total = " + ".join(form.format(c) for c in (part, *others))
    return F.expr(f"`{part}` / ({total} + {RATIO_EPSILON!r}D)")


def sample_std(values: Sequence[str], at_least: int = 2) -> Column:
    """Sample standard deviation over the non-null values of named columns of one row."""
    cols = [f"CAST(`{v}` AS DOUBLE)" for v in values]
    n = " + ".join(f"CAST(`{v}` IS NOT NULL AS INT)" for v in values)
    mean = f"try_divide({' + '.join(f'coalesce({c}, 0D)' for c in cols)}, {n})"
    squares = " + ".join(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0D)" for c in cols)
    return F.expr(f"CASE WHEN {n} >= {at_least} THEN sqrt(try_divide({squares}, {n} - 1)) END")


def dew_point(temp: ColumnLike, humidity: ColumnLike) -> Column:
    """Dew point from temperature and relative humidity; null without humidity."""
    t, rh = _col(temp), _col(humidity)
    return F.when(t.isNotNull() & (rh != 0), half_even(t - (F.lit(100) - rh) / F.lit(5.0), 2))


def year_month(ts: ColumnLike) -> Column:
    """Partition value such as ``2026-03``."""
    return F.date_format(_col(ts), "yyyy-MM")


def path_value(path: ColumnLike, name: str) -> Column:
    """Value of ``name=value`` inside a file path, null if absent."""
    found = F.regexp_extract(_col(path), f"(?:^|/){name}=([^/]+)", 1)
    return F.when(found != "", found)


def iso_seconds(text: ColumnLike) -> Column:
    """``2026-03-01T12:00:00.5+00:00`` to a timestamp of whole seconds; bad text is null."""
    plain = F.substring(F.replace(_col(text), F.lit("T"), F.lit(" ")), 1, 19)
    return F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss"))
