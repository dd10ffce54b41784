"""Canonical values, content hashes, and removal of rows with equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(column: Column, dtype: T.DataType) -> Column:
    """-0.0 as 0.0, every NaN as one, maps as entries sorted by key; null stays null, and
    an empty container stays apart from null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        zero = F.lit(0.0).cast(dtype)
        return F.when(column == zero, zero).when(F.isnan(column), F.lit(float("nan")).cast(dtype)).otherwise(column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(canonical(e["key"], dtype.keyType).alias("key"), canonical(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(dtype, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return column


def canonicalize(df: DataFrame) -> DataFrame:
    """Every column in its canonical form."""
    return df.select(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def content_hash(df: DataFrame, out: str = "content_hash") -> DataFrame:
    """Add the SHA-256 of the row's canonical JSON, the same for equal content in any process."""
    row = F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.withColumn(out, F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


def dedup(df: DataFrame) -> DataFrame:
    """One row for each content; floats and maps compare in canonical form."""
    return content_hash(df, "_content").dropDuplicates(["_content"]).drop("_content")


def key_set(column: str) -> Column:
    """A map's shape: its sorted keys."""
    return F.array_sort(F.map_keys(column))


def with_shape_ids(df: DataFrame, column: str, out: str = "shape_id") -> DataFrame:
    """Add a number for each key set that occurs, from 0 in the key sets' order.

    The key sets of a table are few; there is one row for each of them.
    """
    from .order import numbered

    shapes = numbered(df.select(key_set(column).alias("_shape")).distinct(), "_shape", out=out)
    return df.withColumn("_shape", key_set(column)).join(shapes, "_shape").drop("_shape")
