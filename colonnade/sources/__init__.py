"""Reading and writing tables: presets for files, typed and schemaless reads, raw vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicate import Option
from ..operators.encode import PRESETS
from ..operators.query import evolve, query, typed_subset
from ..storage import shared_folder  # noqa: F401  part of this module's interface


def write(df: DataFrame, path: str, preset: str = "balanced", mode: str = "errorifexists", zone_rows: int | None = None) -> None:
    """Write Parquet under a preset; ``zone_rows``: rows of a page, whose minima and maxima prune."""
    w = df.write.mode(mode).options(**PRESETS[preset])
    if zone_rows:
        w = w.option("parquet.page.row.count.limit", str(zone_rows))
    w.parquet(path)


def append(df: DataFrame, path: str, preset: str = "balanced") -> None:
    write(df, path, preset, "append")


def read(spark: SparkSession, path: str, *options: Option, target: T.StructType | None = None, fill: bool = False) -> DataFrame:
    """Read Parquet under a query's options; ``target``: fields to read, checked, with ``fill``
    those that the files lack as zero."""
    df = spark.read.parquet(path)
    if target is not None:
        df = evolve(df, target) if fill else typed_subset(df, target)
    return query(df, *options)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_variant(spark: SparkSession, path: str, out: str = "value") -> DataFrame:
    """JSON lines without a schema, each a variant."""
    return spark.read.text(path).select(F.parse_json("value").alias(out))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def read_float32(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(path, idx, vec) from files of little-endian 32-bit floats, ``dims`` a vector; a file's
    rest that is no whole vector is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(raw) % (4 * dims):
                    raise ValueError(f"{name}: {len(raw)} bytes are no vectors of {dims}")
                x = np.frombuffer(raw, "<f4").reshape(-1, dims)
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), dims).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), rows], names=["path", "idx", "vec"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, idx bigint, vec array<float>")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """``fn`` over a table's Arrow batches, in the executors: no row becomes a Python object."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(fn, parts)

    return df.mapInArrow(run, schema)


def batches(df: DataFrame, most_rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """A table's rows as Arrow batches of ``most_rows`` rows, one partition after the other, never all at once.

    Batches are made and serialised in the executors; the driver opens their buffers as they are
    and puts small ones together.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, b.num_rows, most_rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b.slice(i, most_rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    waiting: list[pa.RecordBatch] = []
    rows = 0
    for row in df.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        for b in pa.ipc.open_stream(row["batch"]):
            waiting.append(b)
            rows += b.num_rows
            while rows >= most_rows:
                whole = pa.concat_batches(waiting)
                yield whole.slice(0, most_rows)
                rows -= most_rows
                waiting = [whole.slice(most_rows)] if rows else []
    if rows:
        yield pa.concat_batches(waiting)
