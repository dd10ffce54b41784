"""Filter and projection over a table, typed subsets, map keys, and dynamic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldNotFoundError, TypeMismatchError, UnsupportedError
from ..functions.predicate import And, Hint, Option, Predicate, Select
from ..schema import check_kinds, zero_of


def condition(schema: T.StructType, *options: Option) -> Column | None:
    """The conjunction of all predicates among ``options``; None if there are none."""
    terms = tuple(o for o in options if isinstance(o, Predicate))
    return And(terms).lower(schema) if terms else None


def query(df: DataFrame, *options: Option, strict: bool = False) -> DataFrame:
    """Rows for which all predicates are true, with the selected columns.

    Selections add up; columns come in the table's order; a name the table lacks is ignored
    unless ``strict``; a selection without names selects everything.
    """
    for o in options:
        if not isinstance(o, (Predicate, Select, Hint)):
            raise UnsupportedError("query", None, "options", type(o).__name__)
    cond = condition(df.schema, *options)
    out = df if cond is None else df.where(cond)
    names = [n for o in options if isinstance(o, Select) for n in o.names]
    return columns(out, *names, strict=strict) if names else out


def columns(df: DataFrame, *names: str, strict: bool = False) -> DataFrame:
    """The named columns in the table's order."""
    if strict:
        for n in names:
            if n not in df.columns:
                raise FieldNotFoundError("select", n)
    wanted = set(names)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted]) if names else df


def typed_subset(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's fields that the table has, under a check of kinds and nullability."""
    check_kinds(df.schema, target)
    return df.select(*[F.col(f"`{f.name}`") for f in target.fields if f.name in df.columns])


def evolve(df: DataFrame, target: T.StructType) -> DataFrame:
    """All of the target's fields: those that the table lacks hold zero, or null if nullable.

    Columns that the target lacks are dropped.
    """
    check_kinds(df.schema, target)
    out = []
    for f in target.fields:
        if f.name in df.columns:
            out.append(F.col(f"`{f.name}`"))
        else:
            out.append(F.lit(None if f.nullable else zero_of(f.dataType)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def map_keys(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Entries of a map column under the given keys; maps inside its values keep all of theirs.

    Without keys the maps stay whole.
    """
    if not isinstance(df.schema[column].dataType, T.MapType):
        raise TypeMismatchError("map_keys", column, "map", df.schema[column].dataType.simpleString())
    if not keys:
        return df
    return df.withColumn(column, F.map_filter(column, lambda k, _: k.isin(*keys)))


def dynamic_rows(df: DataFrame, out: str = "row") -> DataFrame:
    """Every row as one JSON object that keeps null fields."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(out))


def match_count(df: DataFrame, *options: Option) -> DataFrame:
    """One row: how many rows match, and how many there are."""
    cond = condition(df.schema, *options)
    hit = F.lit(True) if cond is None else cond
    return df.agg(F.count_if(hit).alias("matched"), F.count(F.lit(1)).alias("total"))


def truth_masks(df: DataFrame, *options: Option) -> DataFrame:
    """``df`` with ``is_true``, ``is_false`` and ``is_unknown`` of the predicates for each row."""
    cond = condition(df.schema, *options)
    c = F.lit(True) if cond is None else cond
    return df.withColumn("is_true", F.coalesce(c, F.lit(False))).withColumn("is_false", F.coalesce(~c, F.lit(False))).withColumn("is_unknown", c.isNull())
