"""Custom value codecs: a pair of functions of which either may be missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import UnsupportedError


@dataclass(frozen=True)
class ValueCodec:
    """``encode``: value to bytes, ``decode``: bytes to a value of type ``dtype``.  Nulls pass by."""

    dtype: T.DataType
    encode: Callable[[object], bytes] | None = None
    decode: Callable[[bytes], object] | None = None

    def write(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if self.encode is None:
            raise UnsupportedError("encode", column, "a codec that encodes", "one that decodes only")
        return _mapped(df, column, out, self.encode, T.BinaryType())

    def read(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if self.decode is None:
            raise UnsupportedError("decode", column, "a codec that decodes", "one that encodes only")
        return _mapped(df, column, out, self.decode, self.dtype)


def _mapped(df: DataFrame, column: str, out: str, fn: Callable, dtype: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None else fn(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, dtype)]))
