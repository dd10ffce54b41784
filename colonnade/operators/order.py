"""Row numbers, previous rows and running sums in a given order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import from_halves, low_half, wrapping_add
from ..storage import written

CHUNK = 65_536


def numbered(df: DataFrame, *order_by: str, out: str = "rn") -> DataFrame:
    """Add ``out``: each row's place, from 0, in the order of ``order_by``.

    Rows are dealt to ranges of the order and sorted there; a table with one row for each
    partition holds how many rows come before it.  The dealt rows are written, since another
    run might cut the ranges elsewhere.
    """
    dealt = written(df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    per = dealt.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = dealt.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")  # a row per partition
    return joined.withColumn(out, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_part", "_id", "_before")


def _chunked(df: DataFrame, rn: str) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(rn) / CHUNK))


def with_previous(df: DataFrame, columns: dict[str, str], rn: str = "rn") -> DataFrame:
    """Add for each ``new: column`` the column's value in the row before (null in the first)."""
    w = Window.partitionBy("_chunk").orderBy(rn)
    c = _chunked(df, rn)
    last = c.where((F.col(rn) + 1) % CHUNK == 0).select((F.col("_chunk") + 1).alias("_chunk"), F.struct(*[F.col(v).alias(k) for k, v in columns.items()]).alias("_last"))
    c = c.withColumn("_at", F.col(rn) % CHUNK).join(last, "_chunk", "left")
    for new, old in columns.items():
        c = c.withColumn(new, F.when(F.col("_at") == 0, F.col("_last")[new]).otherwise(F.lag(old).over(w)))
    return c.drop("_chunk", "_last", "_at")


def with_running_sum(df: DataFrame, value: Column | str, out: str, rn: str = "rn") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to this one."""
    value = F.col(value) if isinstance(value, str) else value
    c = _chunked(df, rn).withColumn("_v", value)
    totals = c.groupBy("_chunk").agg(F.sum("_v").alias("_t"))
    before = totals.select("_chunk", F.coalesce(F.sum("_t").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    return c.join(before, "_chunk").withColumn(out, F.sum("_v").over(w) + F.col("_b")).drop("_chunk", "_v", "_b")


def with_wrapping_sum(df: DataFrame, value: str, out: str, rn: str = "rn") -> DataFrame:
    """As :func:`with_running_sum`, of 64-bit integers modulo 2^64: their halves are summed apart, a chunk's sums of them have 48 bits."""
    c = _chunked(df, rn).withColumn("_lo", low_half(F.col(value))).withColumn("_hi", F.shiftrightunsigned(value, 32))
    totals = c.groupBy("_chunk").agg(from_halves(F.sum("_lo"), F.sum("_hi")).alias("_t"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    before = totals.select("_chunk", from_halves(F.coalesce(F.sum(low_half(F.col("_t"))).over(earlier), zero), F.coalesce(F.sum(F.shiftrightunsigned("_t", 32)).over(earlier), zero)).alias("_b"))
    w = Window.partitionBy("_chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    c = c.join(before, "_chunk").withColumn("_lo", F.sum("_lo").over(w)).withColumn("_hi", F.sum("_hi").over(w))
    return c.withColumn(out, wrapping_add(from_halves(F.col("_lo"), F.col("_hi")), F.col("_b"))).drop("_chunk", "_lo", "_hi", "_b")


def with_previous_of(df: DataFrame, group: str, value: str, out: str, rn: str = "rn") -> DataFrame:
    """Add ``out``: ``value`` in the last row before this one with the same ``group`` (nulls are a group).

    Chunks are looked through apart, so that a frequent group is spread over many tasks; a table
    with one row for each chunk and group carries what came last before a chunk.
    """
    c = _chunked(df, rn)
    w = Window.partitionBy("_chunk", group).orderBy(rn)
    last = c.groupBy("_chunk", F.col(group).alias("_g")).agg(F.max_by(F.struct(F.col(value).alias("v")), rn).alias("_last"))
    before = last.select("_chunk", "_g", F.lag("_last").over(Window.partitionBy("_g").orderBy("_chunk")).alias("_before"))
    c = c.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(w)).alias("c")
    b = before.alias("b")
    joined = c.join(b, (F.col("c._chunk") == F.col("b._chunk")) & F.col(f"c.{group}").eqNullSafe(F.col("b._g")), "left")
    return joined.select(*[F.col(f"c.`{x}`") for x in df.columns], F.coalesce("_own", "_before")["v"].alias(out))
