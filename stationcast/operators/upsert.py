"""Keyed upsert into a partitioned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stationcast.functions import year_month
from stationcast.operators.cleaning import dedup_keep_first

KEYS = ("city_slug", "timestamp")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str] = KEYS,
    keep: Sequence[str] = ("city",),
    source_order: Sequence[str] | None = None,
    unique: bool = False,
    trace: bool = False,
) -> DataFrame:
    """Target with the source merged in.

    A matched row takes every source value, nulls included, except the ``keep`` columns. Unmatched
    source rows are added. Several source rows with one key count as the first of them by
    ``source_order`` (default: by all columns; a leading minus orders downwards); ``unique`` says there are none. Null keys match
    nothing and are added.

    With ``trace`` each row tells where it comes from: ``_old`` and ``_new`` say whether the target and the source have it, and
    the target's values, other than the keys, stand in ``_was_`` columns.
    """
    columns = target.columns
    fresh, keyless = _first_by_key(source, columns, keys, source_order, unique)
    # A flag on each side tells a null value from a missing row.
    old = target.withColumn("_old", F.lit(True))
    new = fresh.selectExpr(
        *[f"`{k}`" for k in keys], "true AS _new", *[f"`{c}` AS `_new_{c}`" for c in columns if c not in keys]
    )
    joined = old.join(new, list(keys), "full_outer")

    def pick(c: str) -> str:
        if c in keys:
            return f"`{c}`"
        if c in keep:
            return f"CASE WHEN _old THEN `{c}` ELSE `_new_{c}` END AS `{c}`"
        return f"CASE WHEN _new THEN `_new_{c}` ELSE `{c}` END AS `{c}`"

    said = []
    if trace:
        said = ["coalesce(_old, false) AS _old", "coalesce(_new, false) AS _new", *[f"`{c}` AS `_was_{c}`" for c in columns if c not in keys]]
    merged = joined.selectExpr(*[pick(c) for c in columns], *said)
    if keyless is None:
        return merged
    if trace:
        keyless = keyless.withColumns({"_old": F.lit(False), "_new": F.lit(True)})
    return merged.unionByName(keyless, allowMissingColumns=trace)


def _first_by_key(
    source: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str] | None, unique: bool
) -> tuple[DataFrame, DataFrame | None]:
    """One source row per key, and apart from them the rows without a whole key.

    The latter match nothing, so they are no copies of each other. Kept apart they leave the join the
    partitioning of the aggregate, and as a filter on null keys they are cheap to find.
    """
    if unique:
        return source.select(*columns), None
    order = list(order or columns)
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    rows = source.select(*dict.fromkeys([*columns, *[c.removeprefix("-") for c in order]]))
    first = dedup_keep_first(rows.where(whole), list(keys), order).select(*columns)
    return first, rows.where(f"NOT ({whole})").select(*columns)


def table_or_none(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    try:
        # Without a schema the path is listed and read at once, which is what tells it is missing.
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return spark.read.schema(schema).parquet(path) if schema is not None else found


def touched(source: DataFrame, partition: str) -> list[str | None]:
    """Partition values in a batch: calendar months or days, so a short list."""
    return [r[0] for r in source.select(partition).distinct().collect()]


def in_partitions(df: DataFrame, partition: str, values: list[str | None]) -> DataFrame:
    """Rows of the given partitions; other folders are not read."""
    among = F.col(partition).isin([v for v in values if v is not None])
    return df.where(among | F.col(partition).isNull() if None in values else among)


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    schema: StructType,
    keys: Sequence[str] = KEYS,
    keep: Sequence[str] = ("city",),
    time: str = "timestamp",
    partition: str = "ym",
    source_order: Sequence[str] | None = None,
    unique: bool = False,
) -> None:
    """Merge a batch into the Parquet table at ``path``, which is partitioned by month.

    Only the months in the batch are read and rewritten, with the dynamic overwrite mode set on this
    write: a static overwrite would delete files it still has to read. New files are moved in month by
    month, so a crash in between leaves some months old and some new; running the same batch again
    gives the whole result, since the merge is keyed. Where the table lives in a catalog that supports
    ``MERGE INTO``, that statement is the better choice.
    """
    columns = [f.name for f in schema.fields]
    order = [c for c in (o.removeprefix("-") for o in source_order or []) if c not in columns]
    batch = source.select(*[c for c in columns if c != partition], *order).withColumn(partition, year_month(time))
    existing = table_or_none(spark, path, schema)
    if existing is None:
        merged, keyless = _first_by_key(batch, columns, keys, source_order, unique)
        merged = merged if keyless is None else merged.unionByName(keyless)
    else:
        months = touched(batch, partition)
        if not months:
            return
        current = in_partitions(existing, partition, months).select(*columns)
        merged = upsert(current, batch, keys, [*keep, partition], source_order, unique)
    write_months(merged, path, partition, list(keys))


def write_months(df: DataFrame, path: str, partition: str, sort: list[str]) -> None:
    """Replace the partitions present in ``df``; files are evened out and sorted for pruning."""
    (
        df.hint("rebalance", partition)
        .sortWithinPartitions(partition, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
