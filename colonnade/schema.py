"""Kinds of columns, key metadata, and schema checks."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

from .errors import TypeMismatchError

#: Unsigned 64-bit integers have no Spark type of their own.
UINT64 = T.DecimalType(20, 0)
KEY = "key"


def kind_of(dtype: T.DataType) -> str | None:
    """The queryable kind of a column type; None if predicates can't test it."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if dtype == UINT64:
        return "uint"
    if isinstance(dtype, T.FloatType):
        return "float32"
    if isinstance(dtype, T.DoubleType):
        return "float64"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return None


def literal_kind(value: object) -> str | None:
    """The kind that a literal's Python type stands for."""
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    if isinstance(value, (Decimal, np.unsignedinteger)):
        return "uint"
    if isinstance(value, (int, np.integer)):
        return "int"
    if isinstance(value, np.float32):
        return "float32"
    if isinstance(value, (float, np.floating)):
        return "float64"
    if isinstance(value, str):
        return "string"
    return None


def key_field(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    """A field marked as its table's identity key."""
    return T.StructField(name, dtype, nullable, {KEY: True})


def key_of(schema: T.StructType) -> str | None:
    """The marked key; None if no field or more than one is marked."""
    marked = [f.name for f in schema.fields if f.metadata.get(KEY)]
    return marked[0] if len(marked) == 1 else None


def zero_of(dtype: T.DataType) -> object:
    """What a missing non-nullable field is filled with; None where the type has no zero."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return 0
    if isinstance(dtype, T.DecimalType):
        return Decimal(0)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return 0.0
    if isinstance(dtype, T.StringType):
        return ""
    if isinstance(dtype, T.BooleanType):
        return False
    return None


def check_kinds(have: T.StructType, want: T.StructType) -> None:
    """Fields of both schemas must have one type; a nullable column needs a nullable field."""
    by_name = {f.name: f for f in have.fields}
    for f in want.fields:
        g = by_name.get(f.name)
        if g is None:
            continue
        if g.dataType != f.dataType:
            raise TypeMismatchError("target", f.name, f.dataType.simpleString(), g.dataType.simpleString())
        if g.nullable and not f.nullable:
            raise TypeMismatchError("target", f.name, "not null", "nullable")


def fingerprint(schema: T.StructType) -> str:
    """SHA-256 over names and types in order."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    return hashlib.sha256(text.encode()).hexdigest()
