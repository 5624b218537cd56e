from stationcast.functions.scalars import (
    clamp_class,
    cyclic,
    dew_point,
    drop_nan,
    half_even,
    iso_seconds,
    path_value,
    sample_std,
    settled,
    share_of_total,
    to_class,
    year_month,
)

__all__ = [
    "clamp_class",
    "cyclic",
    "dew_point",
    "drop_nan",
    "half_even",
    "iso_seconds",
    "path_value",
    "sample_std",
    "settled",
    "share_of_total",
    "to_class",
    "year_month",
]
