"""Helpers the operators share: the cluster's shared folder, row identity, prefix sums."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, intermediates, keep, scratch, written  # noqa: F401  used by the operators


def one_row_per_id(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns ``key`` and ``cols`` with one row for each non-null key.

    A null key identifies nothing, so those rows take no part.  Of several rows
    with one key, the one with the smallest values (nulls first) stands.  Keys are
    counted first, which reads only the key column, so that the usual table with
    unique keys isn't shuffled.
    """
    df = df.select(key, *[c for c in cols if c != key]).where(F.col(key).isNotNull())
    if df.groupBy(key).count().where("count > 1").limit(1).count() == 0:
        return df
    rest = [c for c in cols if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_m")).select(key, *[F.col("_m")[c].alias(c) for c in rest])


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't null and is no other row's.  Keys are counted first."""
    df = df.where(F.col(key).isNotNull())
    shared = df.groupBy(key).count().where("count > 1")
    if shared.limit(1).count() == 0:
        return df
    return df.join(shared.select(key), key, "left_anti").select(*df.columns)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows before this one in its group, in order.

    Rows are range-partitioned by (group, order), so a hot group spreads over many
    tasks; each task adds a running sum of its own, and a table with one row for
    each (partition, group) - at most partitions + groups - carries what came before.
    ``row_key`` (unique long) comes with it.  The running sums are a written table, so the
    result is the same each time it is read.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType()), T.StructField("row_key", T.LongType()), T.StructField(out, T.LongType())])
    at = [df.columns.index(g) for g in group]
    vi = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, last, total = 0, None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(vi).to_numpy(zero_copy_only=False).astype(np.int64)
            if at:
                codes = np.zeros(n, bool)
                codes[0] = True
                for i in at:
                    d = b.column(i).dictionary_encode().indices
                    d = np.asarray(d.fill_null(-1))
                    codes[1:] |= d[1:] != d[:-1]
                starts = np.flatnonzero(codes)
            else:
                starts = np.zeros(1, np.int64)
            first = tuple(b.column(i)[0].as_py() for i in at)
            carry = total if last == first and seen else 0
            ends = np.append(starts[1:], n)
            c = np.cumsum(v)
            before = c - v
            base = before[starts]
            run_sum = before - np.repeat(base, ends - starts)
            run_sum[: ends[0]] += carry
            last = tuple(b.column(i)[n - 1].as_py() for i in at)
            total = int(run_sum[-1] + v[-1])
            keys = (np.int64(part) << 40) + np.arange(seen, seen + n, dtype=np.int64)
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(keys), pa.array(run_sum)], names=schema.names)

    dealt = df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).sortWithinPartitions(*group, *order)
    local = written(dealt.mapInArrow(run, schema), name)
    totals = local.groupBy("_part", *group).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (partition, group): bounded by the shuffle partitions plus the groups
    before = totals.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))
    cond = local["_part"] == before["_part"]
    for g in group:
        cond = cond & local[g].eqNullSafe(before[f"_g_{g}"])
    return local.join(F.broadcast(before), cond).select(*[local[c] for c in df.columns], local["row_key"], (local[out] + F.col("_before")).alias(out))


def input_bytes(df: DataFrame, col: str) -> int:
    """About how many bytes ``df`` holds: Spark's estimate from its files, else the sum of ``col``."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 55:
        return size
    return int(df.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Arrow batches of whole texts of at most ``rows`` rows, unless the session has fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tidy() -> None:
    """Give memory that Arrow and the C library hold for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves its worker small for the tasks beside it."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return run
