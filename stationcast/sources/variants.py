"""Landed JSON of unknown shape (S9, S10, S13, H15): fields may be added, missing or of another type.

A line is parsed once into a VARIANT. Known fields are read by a schema: a value of another type counts where
it can be cast, a missing one is null. Everything else, unknown fields and known ones that cannot be read, is
listed with its path and its JSON text, so no line and no value is lost. Lines that are null, no JSON object,
or lack an array that the schema asks for are rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OBJECT, ARRAY = "map<string,variant>", "array<variant>"


def _path(name: str) -> str:
    return f"$['{name}']"


def _form(kind: DataType) -> str:
    """The type a value must have, as far as one level tells."""
    if isinstance(kind, StructType):
        return OBJECT
    return ARRAY if isinstance(kind, ArrayType) else kind.simpleString()


def typed(value: Column, kind: DataType) -> Column:
    """A variant as a column of ``kind``; parts that are missing or cannot be read are null."""
    if isinstance(kind, StructType):
        fields = [typed(F.try_variant_get(value, _path(f.name), "variant"), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.try_variant_get(value, "$", OBJECT).isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(F.try_variant_get(value, "$", ARRAY), lambda v: typed(v, kind.elementType))
    return F.try_variant_get(value, "$", kind.simpleString())


def unread(value: Column, kind: DataType, prefix: Column | None = None) -> Column:
    """(path, value) of every part of a variant that ``typed`` leaves out; JSON null is no value."""
    prefix = F.lit("") if prefix is None else prefix
    if isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", ARRAY)
        each = lambda v, i: unread(v, kind.elementType, F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]")))
        return F.coalesce(F.flatten(F.transform(items, each)), _nothing())
    whole = F.array(F.struct(prefix.alias("path"), F.to_json(value).alias("value")))
    if not isinstance(kind, StructType):
        lost = value.isNotNull() & ~F.is_variant_null(value) & F.try_variant_get(value, "$", kind.simpleString()).isNull()
        return F.when(lost, whole).otherwise(_nothing())

    at = lambda name: F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("."), name))

    def left_out(name: Column, v: Column) -> Column:
        read = F.lit(False)
        for f in kind.fields:
            read |= (name == f.name) & (F.is_variant_null(v) | F.try_variant_get(v, "$", _form(f.dataType)).isNotNull())
        return ~read

    fields = F.try_variant_get(value, "$", OBJECT)
    own = F.transform(
        F.map_entries(F.map_filter(fields, left_out)), lambda e: F.struct(at(e["key"]).alias("path"), F.to_json(e["value"]).alias("value"))
    )
    deeper = [
        unread(F.try_variant_get(value, _path(f.name), "variant"), f.dataType, at(F.lit(f.name)))
        for f in kind.fields
        if isinstance(f.dataType, StructType | ArrayType)
    ]
    return F.concat(F.coalesce(own, _nothing()), *deeper)


def _nothing() -> Column:
    return F.array().cast("array<struct<path:string,value:string>>")


def read_any(lines: DataFrame, schema: StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(responses, rejects) of JSON texts, one per row.

    Responses have the columns of ``schema`` and ``unread``, an array of (path, value) in order of paths; the
    flatten functions take them as they are. Rejects have the column ``line``.
    """
    # A generator, so that filters and projections cannot be pushed past it and parse a line again.
    parsed = lines.select(F.col(column).alias("line"), F.explode(F.array(F.try_parse_json(column))).alias("doc"))
    usable = F.try_variant_get("doc", "$", OBJECT).isNotNull()
    for f in schema.fields:
        if isinstance(f.dataType, ArrayType):
            usable &= F.try_variant_get("doc", _path(f.name), ARRAY).isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    columns = [typed(F.try_variant_get("doc", _path(f.name), "variant"), f.dataType).alias(f.name) for f in schema.fields]
    responses = parsed.where(usable).select(*columns, F.array_sort(unread(F.col("doc"), schema)).alias("unread"))
    return responses, parsed.where(~usable).select("line")


def unread_values(responses: DataFrame, key: str = "city_slug") -> DataFrame:
    """One row per value that the schema does not cover."""
    return responses.select(key, F.inline("unread"))
