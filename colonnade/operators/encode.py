"""Column encodings as table transforms, each with its inverse, profiles, and a recommendation.

All of them take tables numbered in their row order (see :mod:`.order`); files store columns
in their own encodings, so these are for analysis, shipping, and choosing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidPatchError, UnsupportedError
from ..functions.scalar import bit_length, common_prefix, common_suffix, from_uint_bits, index_width, uint_bits, varint_length, wrapping_add, wrapping_sub, zigzag
from ..schema import UINT64
from .order import numbered, with_previous, with_previous_of, with_running_sum, with_wrapping_sum

BLOCK = 256
ANCHOR = 64
MOST_CODES = 64


# Integers
#
# Differences wrap at 2^64, so columns may hold any 64-bit integers; unsigned ones, as decimal(20,0),
# are taken by their bits.  Offsets and widths are unsigned.


def _bits(df: DataFrame, column: str, c: Column | None = None) -> Column:
    """A column's integers (or ``c``, a value of it) as 64 bits."""
    c = F.col(column) if c is None else c
    return uint_bits(c) if df.schema[column].dataType == UINT64 else c.cast("bigint")


def _value(bits: Column, unsigned: bool) -> Column:
    return from_uint_bits(bits) if unsigned else bits


def _range(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(base, width): aggregates over ``df``, the least value's bits and the bits of the range."""
    base = _bits(df, column, F.min(column))
    return base, bit_length(wrapping_sub(_bits(df, column, F.max(column)), base))


def frame_of_reference(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, base, width, packed): packed = value - base, in ``width`` bits."""
    base, width = _range(df, column)
    stats = df.agg(base.alias("base"), width.alias("width"))
    return df.select(rn, _bits(df, column).alias("_v")).crossJoin(F.broadcast(stats)).select(rn, "base", "width", wrapping_sub(F.col("_v"), F.col("base")).alias("packed"))  # one row


def from_frame_of_reference(encoded: DataFrame, column: str, rn: str = "rn", unsigned: bool = False) -> DataFrame:
    return encoded.select(rn, _value(wrapping_add(F.col("base"), F.col("packed")), unsigned).alias(column))


def delta_encode(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, delta): the first value, then differences from the row before."""
    c = df.select(rn, _bits(df, column).alias("_v"))
    return with_previous(c, {"_p": "_v"}, rn).select(rn, wrapping_sub(F.col("_v"), F.coalesce("_p", F.lit(0).cast("bigint"))).alias("delta"))


def delta_decode(encoded: DataFrame, column: str, rn: str = "rn", unsigned: bool = False) -> DataFrame:
    return with_wrapping_sum(encoded, "delta", "_total", rn).select(rn, _value(F.col("_total"), unsigned).alias(column))


def delta_frame_encode(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, first, base, width, packed): differences from the row before as offsets from the least of them."""
    c = with_previous(df.select(rn, _bits(df, column).alias("_v")), {"_p": "_v"}, rn)
    c = c.select(rn, "_v", F.when(F.col(rn) > 0, wrapping_sub(F.col("_v"), F.col("_p"))).alias("_d"))
    stats = c.agg(F.min_by("_v", rn).alias("first"), F.min("_d").alias("base"), bit_length(wrapping_sub(F.max("_d"), F.min("_d"))).alias("width"))
    return c.crossJoin(F.broadcast(stats)).select(rn, "first", "base", "width", wrapping_sub(F.col("_d"), F.col("base")).alias("packed"))  # one row


def delta_frame_decode(encoded: DataFrame, column: str, rn: str = "rn", unsigned: bool = False) -> DataFrame:
    step = F.when(F.col(rn) > 0, wrapping_add(F.col("base"), F.col("packed"))).otherwise(F.col("first"))
    return delta_decode(encoded.select(rn, step.alias("delta")), column, rn, unsigned)


def run_length_encode(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(run, value, start, length), runs from 0; nulls make runs of their own."""
    c = with_previous(df.select(rn, F.col(column).alias("value")), {"_p": "value"}, rn)
    new = (F.col(rn) == 0) | ~F.col("value").eqNullSafe(F.col("_p"))
    c = with_running_sum(c, F.when(new, 1).otherwise(0), "run", rn)
    return c.groupBy((F.col("run") - 1).alias("run")).agg(F.first("value").alias("value"), F.min(rn).alias("start"), F.count(F.lit(1)).alias("length"))


def run_length_decode(encoded: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    return encoded.select(F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias(rn), F.col("value").alias(column))


def dictionary(df: DataFrame, column: str, rn: str = "rn", seed: tuple = ()) -> DataFrame:
    """(value, code): distinct values that aren't null, numbered by first occurrence; those of
    ``seed`` come first whether they occur or not."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(rn).alias("_first"))
    if seed:
        given = df.sparkSession.createDataFrame([(v, i - len(seed)) for i, v in enumerate(dict.fromkeys(seed))], f"value {df.schema[column].dataType.simpleString()}, _first bigint")
        firsts = firsts.unionByName(given).groupBy("value").agg(F.min("_first").alias("_first"))
    return numbered(firsts, "_first", out="code").select("value", "code")


def dictionary_encode(df: DataFrame, column: str, rn: str = "rn") -> tuple[DataFrame, DataFrame]:
    """(dictionary, codes): codes has (rn, code), null for null."""
    table = dictionary(df, column, rn)
    return table, df.select(rn, F.col(column).alias("_v")).join(table, F.col("_v") == F.col("value"), "left").select(rn, "code")


def dictionary_decode(table: DataFrame, codes: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    return codes.join(table, "code", "left").select(rn, F.col("value").alias(column))


def patched_width(df: DataFrame, column: str) -> DataFrame:
    """(base, full_width, width, exceptions, cost) with the least cost.

    Values' offsets are counted by bit width; a body width's cost is its bits for all rows
    and, for each offset that doesn't fit, its place (2 bytes) and its varint.
    """
    least, full = _range(df, column)
    base = df.agg(least.alias("base"), F.count(column).alias("n"), full.alias("full_width"))
    off = wrapping_sub(F.col("_v"), F.col("base"))
    wide = df.select(_bits(df, column).alias("_v")).where("_v IS NOT NULL").crossJoin(F.broadcast(base)).select("base", "n", "full_width", bit_length(off).alias("w"), varint_length(off).alias("b"))
    hist = wide.groupBy("base", "n", "full_width", "w").agg(F.count(F.lit(1)).alias("k"), F.sum("b").alias("bytes"))  # 65 rows at most
    body = hist.select("base", "n", "full_width").distinct().withColumn("width", F.explode(F.sequence(F.lit(0), F.col("full_width"))))
    over = body.join(hist.select("w", "k", "bytes"), F.col("w") > F.col("width"), "left").groupBy("base", "n", "full_width", "width").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("exceptions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("_b"))
    cost = F.ceil(F.col("n") * F.col("width") / 8) + 2 * F.col("exceptions") + F.col("_b")
    return over.withColumn("cost", cost.cast("bigint")).orderBy("cost", "width").limit(1).select("base", "full_width", "width", "exceptions", "cost")


def patched_encode(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, base, width, body, patch): the offset's low bits, and what stands above them (0 for most rows)."""
    plan = patched_width(df, column)
    c = df.select(rn, _bits(df, column).alias("_v")).crossJoin(F.broadcast(plan)).select(rn, "base", F.col("width").cast("int").alias("width"), wrapping_sub(F.col("_v"), F.col("base")).alias("_off"))
    # a shift by 64 bits is one by none
    low = F.when(F.col("width") < 64, F.expr("_off & ~shiftleft(-1L, width)")).otherwise(F.col("_off"))
    return c.select(rn, "base", "width", low.alias("body"), F.when(F.col("width") < 64, F.expr("shiftrightunsigned(_off, width)")).otherwise(0).alias("patch"))


def patched_decode(encoded: DataFrame, column: str, rn: str = "rn", unsigned: bool = False) -> DataFrame:
    off = F.when(F.col("width") < 64, F.expr("body | shiftleft(patch, width)")).otherwise(F.col("body"))
    return encoded.select(rn, _value(wrapping_add(F.col("base"), off), unsigned).alias(column))


def block_profile(df: DataFrame, column: str, rn: str = "rn", rows: int = BLOCK) -> DataFrame:
    """(block, n, lo, hi, width) for blocks of ``rows`` rows."""
    return df.groupBy(F.floor(F.col(rn) / rows).cast("bigint").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), _range(df, column)[1].alias("width"))


#: Block sizes that may be chosen, besides a single block for the whole column.
BLOCK_SIZES = (256, 1024)
BLOCK_HEAD = 12  # a block's base, width and place


def block_choice(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row: rows of a block (0: the column is one block), blocks, bytes - the fewest bytes, the larger block among equals.

    A block costs its values' offsets in its own width and ``BLOCK_HEAD`` bytes.  Columns shorter than two of the
    smallest blocks are one block.
    """
    cost = (F.ceil(F.col("n") * F.col("width") / 8) + BLOCK_HEAD).cast("bigint")
    whole = df.agg(F.count(column).alias("n"), _range(df, column)[1].alias("width")).select(F.lit(0).alias("rows"), F.lit(1).cast("bigint").alias("blocks"), cost.alias("bytes"))
    for rows in BLOCK_SIZES:
        one = block_profile(df, column, rn, rows).agg(F.count(F.lit(1)).alias("blocks"), F.sum(cost).alias("bytes"), F.sum("n").alias("n"))
        whole = whole.unionByName(one.where(F.col("n") >= 2 * BLOCK_SIZES[0]).select(F.lit(rows).alias("rows"), "blocks", "bytes"))
    return whole.orderBy("bytes", F.when(F.col("rows") > 0, -F.col("rows")).otherwise(F.lit(-(1 << 30)))).limit(1)


def block_encode(df: DataFrame, column: str, rn: str = "rn", rows: int | None = None) -> DataFrame:
    """(rn, base, width, packed): offsets within blocks of ``rows`` rows, those of :func:`block_choice` if not given."""
    if rows is None:
        rows = block_choice(df, column, rn).first()["rows"]
    if not rows:
        return frame_of_reference(df, column, rn)
    block = F.floor(F.col(rn) / rows).cast("bigint")
    base, width = _range(df, column)
    heads = df.groupBy(block.alias("_block")).agg(base.alias("base"), width.alias("width"))
    return df.select(rn, _bits(df, column).alias("_v"), block.alias("_block")).join(heads, "_block").select(rn, "base", "width", wrapping_sub(F.col("_v"), F.col("base")).alias("packed"))


def bool_pack(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(byte, bits): eight rows' truths in a byte, the first in its lowest bit."""
    return df.groupBy(F.floor(F.col(rn) / 8).cast("bigint").alias("byte")).agg(F.sum(F.when(F.col(column), F.call_function("shiftleft", F.lit(1), (F.col(rn) % 8).cast("int"))).otherwise(0)).cast("bigint").alias("bits"), F.count(F.lit(1)).alias("n"))


def bool_unpack(encoded: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    out = encoded.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return out.select((F.col("byte") * 8 + F.col("_i")).alias(rn), (F.expr("shiftright(bits, _i)").bitwiseAND(F.lit(1)) == 1).alias(column))


def nullable_split(df: DataFrame, column: str, rn: str = "rn") -> tuple[DataFrame, DataFrame]:
    """(presence bits by eight rows, values that aren't null with their place among these)."""
    mask = bool_pack(df.select(rn, F.col(column).isNotNull().alias("_p")), "_p", rn)
    dense = with_running_sum(df.select(rn, F.col(column).alias("value")), F.when(F.col("value").isNotNull(), 1).otherwise(0), "_k", rn).where("value IS NOT NULL").select((F.col("_k") - 1).cast("bigint").alias("place"), "value")
    return mask, dense


def nullable_join(mask: DataFrame, dense: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    there = with_running_sum(bool_unpack(mask, "_p", rn), F.when(F.col("_p"), 1).otherwise(0), "_k", rn)
    there = there.withColumn("place", F.when(F.col("_p"), F.col("_k") - 1).cast("bigint"))
    return there.join(dense, "place", "left").select(rn, F.col("value").alias(column))


def byte_planes(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, planes): as many bytes of an integer as its type has, the highest first; null for null."""
    width = {"tinyint": 1, "smallint": 2, "int": 4}.get(df.schema[column].dataType.simpleString(), 8)
    v = _bits(df, column)
    planes = F.array(*[F.shiftright(v, 8 * i).bitwiseAND(F.lit(0xFF)).cast("smallint") for i in reversed(range(width))])
    return df.select(rn, F.when(v.isNotNull(), planes).alias("planes"))


def from_byte_planes(encoded: DataFrame, column: str, rn: str = "rn", unsigned: bool = False) -> DataFrame:
    # the highest byte has the sign
    sign = F.when(F.col("planes")[0] >= 128, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    v = F.aggregate("planes", sign, lambda a, x: F.shiftleft(a, 8).bitwiseOR(x.cast("bigint")))
    return encoded.select(rn, _value(v, unsigned).alias(column))


# Floats


def _no_decimal(df: DataFrame, column: str, d: int) -> Column:
    """Whether a float differs from rint(v * 10^d) / 10^d in its own precision, or has no such form."""
    kind, c = df.schema[column].dataType, F.col(column).cast("double")
    odd = F.isnan(c) | (F.abs(c) == math.inf) | (c.cast("string") == "-0.0") | (F.abs(c * 10.0**d) > 9.0e15)
    return odd | ((F.rint(c * 10.0**d) / F.lit(10.0**d)).cast(kind) != F.col(column))


def decimal_exponent(df: DataFrame, column: str, most: int = 15) -> DataFrame:
    """(exponent, exceptions, n): the least d in 0..most for which the fewest doubles or floats differ
    from rint(v * 10^d) / 10^d, over all rows.  NaN, infinities and -0.0 are always exceptions."""
    c = F.col(column)
    bad = [F.count_if(_no_decimal(df, column, d)).alias(f"e{d}") for d in range(most + 1)]
    one = df.agg(F.count(c).alias("n"), *bad)
    each = one.select("n", F.explode(F.array(*[F.struct(F.col(f"e{d}").alias("exceptions"), F.lit(d).alias("exponent")) for d in range(most + 1)])).alias("x"))
    return each.orderBy("x.exceptions", "x.exponent").limit(1).select("x.exponent", "x.exceptions", "n")


def decimal_encode(df: DataFrame, column: str, exponent: int, rn: str = "rn") -> DataFrame:
    """(rn, mantissa, exception): mantissa / 10^exponent is the value, else it is the exception."""
    c, odd = F.col(column), _no_decimal(df, column, exponent)
    return df.select(rn, F.when(~odd, F.rint(c.cast("double") * 10.0**exponent).cast("bigint")).alias("mantissa"), F.when(odd, c).alias("exception"))


def decimal_decode(encoded: DataFrame, column: str, exponent: int, rn: str = "rn") -> DataFrame:
    kind = encoded.schema["exception"].dataType
    return encoded.select(rn, F.coalesce("exception", (F.col("mantissa") / F.lit(10.0**exponent)).cast(kind)).alias(column))


def _width(df: DataFrame, column: str) -> int:
    """Bits of a column of floats."""
    return 32 if isinstance(df.schema[column].dataType, T.FloatType) else 64


def _pattern(values: pd.Series, width: int) -> np.ndarray:
    """Floats' bits, in 64-bit integers."""
    return values.to_numpy(np.float64).view(np.uint64) if width == 64 else values.to_numpy(np.float32).view(np.uint32).astype(np.uint64)


def _grouped_codec(df: DataFrame, column: str, rn: str, rows: int, fn, schema: str) -> DataFrame:
    """``fn`` over blocks of ``rows`` rows in order: a codec that looks back starts anew in each."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(rn))

    return df.select(rn, F.col(column).alias("value"), F.floor(F.col(rn) / rows).cast("bigint").alias("block")).groupBy("block").applyInPandas(one, schema)


def xor_encode(df: DataFrame, column: str, rn: str = "rn", rows: int = 4096) -> DataFrame:
    """(block, rn, xor, leading, meaningful) of doubles or floats: each with the one before it, by bits."""
    size = _width(df, column)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = _pattern(pdf["value"], size)
        x = bits ^ np.append(np.uint64(0), bits[:-1])
        lead, trail = _zeros(x)
        return pd.DataFrame({"block": pdf["block"], rn: pdf[rn], "xor": x.view(np.int64), "leading": lead - (64 - size), "meaningful": np.where(x == 0, 0, 64 - lead - trail)})

    return _grouped_codec(df, column, rn, rows, fn, f"block bigint, {rn} bigint, xor bigint, leading int, meaningful int")


def _zeros(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.zeros(len(x), np.int32)
    v = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        low = v < (np.uint64(1) << np.uint64(64 - s))
        lead += np.where(low, s, 0).astype(np.int32)
        v = np.where(low, v << np.uint64(s), v)
    trail = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int32)
    return np.where(x == 0, 64, lead).astype(np.int32), np.where(x == 0, 64, trail).astype(np.int32)


def _floats(bits: np.ndarray, width: int) -> pa.Array:
    """Arrow keeps a NaN apart from a null."""
    return pa.array(bits.view(np.float64) if width == 64 else bits.astype(np.uint32).view(np.float32))


def _grouped_floats(encoded: DataFrame, column: str, rn: str, width: int, fn) -> DataFrame:
    """``fn`` turns each block, in order, to the bits of floats of ``width`` bits."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(rn)
        return pa.table({rn: table.column(rn), column: _floats(fn(table), width)})

    return encoded.groupBy("block").applyInArrow(one, f"{rn} bigint, {column} {'double' if width == 64 else 'float'}")


def xor_decode(encoded: DataFrame, column: str, rn: str = "rn", width: int = 64) -> DataFrame:
    return _grouped_floats(encoded, column, rn, width, lambda t: np.bitwise_xor.accumulate(t.column("xor").to_numpy().view(np.uint64)))


def xor_window_encode(df: DataFrame, column: str, rn: str = "rn", rows: int = 4096, back: int = 128) -> DataFrame:
    """(block, rn, ref, xor): doubles or floats with that of the ``back`` values before whose XOR ends in most zeros."""
    size = _width(df, column)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = _pattern(pdf["value"], size)
        n = len(bits)
        best, ref, out = np.full(n, -1), np.zeros(n, np.int64), bits.copy()
        for k in range(1, min(back, n - 1) + 1):
            x = bits[k:] ^ bits[:-k]
            better = _zeros(x)[1] > best[k:]
            best[k:] = np.where(better, _zeros(x)[1], best[k:])
            ref[k:] = np.where(better, k, ref[k:])
            out[k:] = np.where(better, x, out[k:])
        return pd.DataFrame({"block": pdf["block"], rn: pdf[rn], "ref": ref, "xor": out.view(np.int64)})

    return _grouped_codec(df, column, rn, rows, fn, f"block bigint, {rn} bigint, ref bigint, xor bigint")


def xor_window_decode(encoded: DataFrame, column: str, rn: str = "rn", width: int = 64) -> DataFrame:
    def fn(table: pa.Table) -> np.ndarray:
        bits = table.column("xor").to_numpy().view(np.uint64).copy()
        for i, k in enumerate(table.column("ref").to_pylist()):
            if k:
                bits[i] ^= bits[i - k]
        return bits

    return _grouped_floats(encoded, column, rn, width, fn)


def real_double_encode(df: DataFrame, column: str, rn: str = "rn", rows: int = 4096, most: int = 8) -> DataFrame:
    """(block, rn, cut, code, left, right): the upper bits of a double or float as one of ``most``
    frequent values (code -1: an exception in ``left``), the lower ``cut`` bits as they are.

    Each block's cut, which leaves 1 to 16 upper bits, is the one with the fewest bits altogether.
    """
    size = _width(df, column)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = _pattern(pdf["value"], size)
        plans = []
        for cut in range(size - 16, size):
            top = Counter((bits >> np.uint64(cut)).tolist()).most_common(most)
            hit = sum(k for _, k in top)
            width = max(1, (len(top) - 1).bit_length()) if len(top) > 1 else 0
            plans.append((len(bits) * (cut + width) + (len(bits) - hit) * (size - cut + 16), cut, sorted(v for v, _ in top)))
        _, cut, table = min(plans)
        left = bits >> np.uint64(cut)
        at = {v: i for i, v in enumerate(table)}
        code = np.array([at.get(v, -1) for v in left.tolist()], np.int64)
        return pd.DataFrame({"block": pdf["block"], rn: pdf[rn], "cut": cut, "code": code, "left": left.view(np.int64), "right": (bits & ((np.uint64(1) << np.uint64(cut)) - np.uint64(1))).view(np.int64)})

    return _grouped_codec(df, column, rn, rows, fn, f"block bigint, {rn} bigint, cut int, code bigint, left bigint, right bigint")


def real_double_decode(encoded: DataFrame, column: str, rn: str = "rn", width: int = 64) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut, left, right = (np.asarray(b.column(b.schema.get_field_index(x))).astype(np.int64).view(np.uint64) for x in ("cut", "left", "right"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(rn)), _floats((left << cut) | right, width)], names=[rn, column])

    return encoded.mapInArrow(run, f"{rn} bigint, {column} {'double' if width == 64 else 'float'}")


# Strings


def front_code(df: DataFrame, column: str) -> DataFrame:
    """(place, shared, suffix): distinct values sorted, each by the bytes it shares with the one before."""
    values = numbered(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), "value", out="place")
    return with_previous(values, {"_p": "value"}, "place").select("place", F.coalesce(common_prefix(F.col("value"), F.col("_p")), F.lit(0)).alias("shared"), "value").select("place", "shared", F.expr("substring(cast(value as binary), shared + 1)").cast("string").alias("suffix"))


def front_delta(df: DataFrame, column: str, rn: str = "rn", anchor: int = ANCHOR) -> DataFrame:
    """(rn, prefix, suffix, middle): bytes shared with the row before at either end, and what is
    between; every ``anchor``-th row stands whole."""
    c = with_previous(df.select(rn, F.col(column).alias("value")), {"_p": "value"}, rn)
    whole = (F.col(rn) % anchor == 0) | F.col("_p").isNull() | F.col("value").isNull()
    pre = F.when(whole, 0).otherwise(common_prefix(F.col("value"), F.col("_p")))
    c = c.withColumn("prefix", pre)
    room = F.least(F.octet_length("value"), F.octet_length("_p")) - F.col("prefix")
    c = c.withColumn("suffix", F.when(whole, 0).otherwise(F.least(common_suffix(F.col("value"), F.col("_p")), room)))
    return c.select(rn, "prefix", "suffix", F.expr("cast(substring(cast(value as binary), prefix + 1, octet_length(value) - prefix - suffix) as string)").alias("middle"))


def field_delta(df: DataFrame, columns: list[str], rn: str = "rn") -> DataFrame:
    """(rn, and for each text column a struct): same as the row before's, or prefix, suffix and middle
    to it; rows that stand whole are those of :func:`front_delta`."""
    c = with_previous(df.select(rn, *columns), {f"_p{i}": x for i, x in enumerate(columns)}, rn)

    def one(x: str, p: str) -> Column:
        v, last = F.col(x), F.col(p)
        whole = (F.col(rn) % ANCHOR == 0) | last.isNull() | v.isNull()
        pre = F.when(whole, 0).otherwise(common_prefix(v, last))
        suf = F.when(whole, 0).otherwise(F.least(common_suffix(v, last), F.least(F.octet_length(v), F.octet_length(last)) - pre))
        middle = F.call_function("substring", v.cast("binary"), (pre + 1).cast("int"), (F.octet_length(v) - pre - suf).cast("int")).cast("string")
        return F.struct((~whole & (v == last)).alias("same"), pre.alias("prefix"), suf.alias("suffix"), middle.alias("middle")).alias(x)

    return c.select(rn, *[one(x, f"_p{i}") for i, x in enumerate(columns)])


def field_delta_decode(encoded: DataFrame, columns: list[str], rn: str = "rn") -> DataFrame:
    """Rows again; a column at a time, blocks from anchor to anchor on their own."""
    out = None
    for x in columns:
        one = front_delta_decode(encoded.select(rn, f"{x}.prefix", f"{x}.suffix", f"{x}.middle"), x, rn)
        out = one if out is None else out.join(one, rn)
    return out


def front_delta_decode(encoded: DataFrame, column: str, rn: str = "rn", anchor: int = ANCHOR) -> DataFrame:
    """Blocks from anchor to anchor are decoded on their own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, last = pdf.sort_values(rn), [], b""
        for p, s, m in zip(pdf["prefix"], pdf["suffix"], pdf["middle"]):
            if m is None:
                out.append(None)
                last = b""
                continue
            last = last[: int(p)] + m.encode() + (last[len(last) - int(s) :] if s else b"")
            out.append(last.decode())
        return pd.DataFrame({rn: pdf[rn], column: out})

    return encoded.withColumn("_g", F.floor(F.col(rn) / anchor)).groupBy("_g").applyInPandas(one, f"{rn} bigint, {column} string")


def alphabet(df: DataFrame, column: str) -> DataFrame:
    """One row: chars (distinct), bits for each, total characters."""
    chars = df.where(F.col(column).isNotNull()).select(F.explode(F.split(column, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.agg(F.count(F.lit(1)).alias("chars"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select("chars", index_width(F.col("chars")).alias("bits"), "total")


def _alphabet_letters(df: DataFrame, column: str) -> list[str]:
    rows = df.where(F.col(column).isNotNull()).select(F.explode(F.split(column, "")).alias("ch")).where("ch <> ''").distinct().limit(MOST_CODES + 1).collect()  # bounded
    if len(rows) > MOST_CODES:
        raise UnsupportedError("alphabet", column, f"{MOST_CODES} characters at most", "more")
    return sorted(r["ch"] for r in rows)


def alphabet_encode(df: DataFrame, column: str, out: str = "packed") -> tuple[list[str], DataFrame]:
    """(letters, ``df`` with ``out``): each value as its letters' numbers in as few bits as tell
    them apart, the first highest, after the value's length in four bytes; null for null."""
    letters = _alphabet_letters(df, column)
    bits, code = max(0, (len(letters) - 1).bit_length()) if letters else 0, {c: i for i, c in enumerate(letters)}

    def pack(text: str) -> bytes:
        n = 0
        for c in text:
            n = n << bits | code[c]
        size = -(-len(text) * bits // 8)
        return len(text).to_bytes(4, "little") + n.to_bytes(size, "little")

    return letters, _byte_map(df, column, out, pack, pa.binary(), T.BinaryType())


def alphabet_decode(df: DataFrame, packed: str, letters: list[str], out: str) -> DataFrame:
    bits = max(0, (len(letters) - 1).bit_length()) if letters else 0

    def back(raw: bytes) -> str:
        size, n = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:], "little")
        return "".join(letters[n >> bits * (size - 1 - i) & (1 << bits) - 1] for i in range(size))

    return _byte_map(df, packed, out, back, pa.string(), T.StringType())


def _byte_map(df: DataFrame, column: str, out: str, fn, kind: pa.DataType, dtype: T.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None else fn(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, dtype)]))


def slab_encode(df: DataFrame, column: str, rn: str = "rn", rows: int = 4096) -> DataFrame:
    """(block, slab, handles): a block's values as one string of bytes and (rn, offset, length) for
    each row; a null has offset -1."""
    c = df.select(rn, F.col(column).alias("v"), F.floor(F.col(rn) / rows).cast("bigint").alias("block"))
    w = Window.partitionBy("block").orderBy(rn).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length("v"), F.lit(0))
    c = c.withColumn("length", size).withColumn("offset", F.when(F.col("v").isNull(), -1).otherwise(F.coalesce(F.sum("length").over(w), F.lit(0))).cast("bigint"))
    parts = c.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(rn, "offset", "length", F.coalesce("v", F.lit("")).alias("v")))).alias("x"))  # a block's rows
    return parts.select("block", F.encode(F.array_join(F.transform("x", lambda e: e["v"]), ""), "utf-8").alias("slab"), F.transform("x", lambda e: F.struct(e[rn].alias(rn), e["offset"].alias("offset"), e["length"].alias("length"))).alias("handles"))


def slab_decode(encoded: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """Each handle's bytes of its slab."""
    h = encoded.select("slab", F.explode("handles").alias("h"))
    value = F.call_function("substring", F.col("slab"), (F.col("h.offset") + 1).cast("int"), F.col("h.length").cast("int")).cast("string")
    return h.select(F.col(f"h.{rn}").alias(rn), F.when(F.col("h.offset") >= 0, value).alias(column))


def state_references(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, form): the shortest way to tell each value: repeat (of the row before), pair (what last
    followed the value before it), known (seen before), new."""
    c = with_previous(df.select(rn, F.col(column).alias("v")), {"p": "v"}, rn)
    c = with_previous_of(c, "p", "v", "pair", rn)
    c = c.join(df.groupBy(F.col(column).alias("_v")).agg(F.min(rn).alias("first")), F.col("v").eqNullSafe(F.col("_v")))
    form = F.when(F.col("v") == F.col("p"), "repeat").when(F.col("p").isNotNull() & (F.col("pair") == F.col("v")), "pair").when(F.col("first") < F.col(rn), "known").otherwise("new")
    return c.select(rn, form.alias("form"))


def column_prefix(df: DataFrame, column: str) -> DataFrame:
    """One row: bytes that all values begin with, which are those that the least and the greatest share."""
    return df.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(common_prefix(F.col("a"), F.col("b")).alias("shared"))


def high_cardinality(df: DataFrame, column: str, share: float = 0.7) -> DataFrame:
    """One row: whether more than ``share`` of the values are distinct, by an approximate count."""
    return df.agg((F.approx_count_distinct(column, 0.02) > F.count(column) * share).alias("high"))


def delta_statistics(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row: first, least and greatest difference to the row before, and the bits of their range."""
    c = with_previous(df.select(rn, _bits(df, column).alias("v")), {"p": "v"}, rn)
    d = wrapping_sub(F.col("v"), F.col("p"))
    return c.agg(F.min_by("v", rn).alias("first"), F.min(d).alias("least"), F.max(d).alias("greatest"), bit_length(wrapping_sub(F.max(d), F.min(d))).alias("bits"))


def byte_histogram(df: DataFrame, column: str) -> DataFrame:
    """(byte, n) over all texts' bytes."""
    hexes = F.hex(F.encode(F.col(column), "utf-8"))
    pairs = df.where(F.col(column).isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(0), F.octet_length(column) - 1), lambda i: F.substr(hexes, 2 * i + 1, F.lit(2)))).alias("h")).where("h <> ''")
    return pairs.groupBy(F.conv("h", 16, 10).cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))


def entropy(hist: DataFrame) -> DataFrame:
    """One row: symbols, total, bits per symbol."""
    total = hist.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return hist.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("symbols"), F.first("total").alias("total"), F.sum(-p * F.log2(p)).alias("bits"))


def markov_repeat(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, repeat): whether the value is that of the row before."""
    c = with_previous(df.select(rn, F.col(column).alias("v")), {"_p": "v"}, rn)
    return c.select(rn, F.coalesce(F.col("v") == F.col("_p"), F.lit(False)).alias("repeat"))


def markov_pair(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(rn, value, prev, hit): whether the value is what last followed the value before it."""
    c = with_previous(df.select(rn, F.col(column).alias("value")), {"prev": "value"}, rn)
    c = with_previous_of(c, "prev", "value", "_last", rn)
    guess = F.when(F.col("prev").isNotNull(), F.col("_last"))
    return c.select(rn, "value", "prev", F.coalesce(guess == F.col("value"), F.lit(False)).alias("hit"))


def move_to_front(df: DataFrame, column: str, rn: str = "rn", rows: int = 65_536) -> DataFrame:
    """(rn, rank): how many other values occurred since this one last did; null at its first sight.

    Blocks of ``rows`` rows are ranked apart; each begins with the last rows of all values
    seen before it.
    """
    c = df.select(rn, F.col(column).alias("value"), F.floor(F.col(rn) / rows).cast("bigint").alias("block"))
    seen = c.groupBy("block", "value").agg(F.max(rn).alias(rn))
    blocks = seen.select("block").distinct().withColumn("no", F.row_number().over(Window.orderBy("block")))  # a row per block
    until = F.coalesce(F.lead("no").over(Window.partitionBy("value").orderBy("no")), F.col("last"))
    spans = seen.join(blocks, "block").crossJoin(F.broadcast(blocks.agg(F.max("no").alias("last")))).select(rn, "value", "no", until.alias("until")).where("no < until")
    carried = spans.select(rn, "value", F.explode(F.sequence(F.col("no") + 1, F.col("until"))).alias("no")).join(blocks, "no")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rn)
        last: dict[int, int] = {}
        order: list[int] = []  # the values' last rows, ascending
        out = []
        for r, v in zip(pdf[rn].tolist(), pd.factorize(pdf["value"], use_na_sentinel=False)[0].tolist()):
            if v in last:
                k = bisect_left(order, last[v])
                out.append(len(order) - 1 - k)
                del order[k]
            else:
                out.append(None)
            order.append(r)
            last[v] = r
        return pd.DataFrame({rn: pdf[rn].array, "rank": pd.array(out, "Int64")})[~pdf["carried"].to_numpy()]

    both = c.withColumn("carried", F.lit(False)).unionByName(carried.select(rn, "value", "block", F.lit(True).alias("carried")))
    return both.groupBy("block").applyInPandas(one, f"{rn} bigint, rank bigint")


def move_to_front_decode(encoded: DataFrame, firsts: DataFrame, column: str, rn: str = "rn", rows: int = 65_536) -> DataFrame:
    """Inverse; ``firsts``: (rn, value) of the rows whose rank is null.

    Blocks are decoded apart, to values or slots of the list that the block begins with.
    These lists are then made block by block, from one row per block and value used in it.
    """
    j = encoded.join(firsts, rn, "left").withColumn("block", F.floor(F.col(rn) / rows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, recent, taken, out = pdf.sort_values(rn), [], [], []  # recent: (slot, value) used in the block; a value's own slot is -1
        for r, k, v in zip(pdf[rn], pdf["rank"], pdf["value"]):
            if pd.isna(k):
                x = (-1, v)
            elif k < len(recent):
                x = recent.pop(int(k))
            else:
                slot = int(k) - len(recent)
                for t in taken:
                    if t > slot:
                        break
                    slot += 1
                insort(taken, slot)
                x = (slot, None)
            recent.insert(0, x)
            out.append((r, -1, *x))
        out += [(-1, place, *x) for place, x in enumerate(recent)]
        return pd.DataFrame(out, columns=[rn, "place", "slot", "value"]).assign(block=pdf["block"].iloc[0])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = [], []
        for block, part in pdf.sort_values(["block", "place"]).groupby("block"):
            used = list(zip(part["slot"].tolist(), part["value"].tolist()))
            taken = {slot for slot, _ in used if slot >= 0}
            out += [(block, slot, now[slot]) for slot in taken]
            now = [now[slot] if slot >= 0 else v for slot, v in used] + [v for slot, v in enumerate(now) if slot not in taken]
        return pd.DataFrame(out, columns=["block", "slot", "value"])

    steps = j.groupBy("block").applyInPandas(one, f"{rn} bigint, place bigint, slot bigint, value string, block bigint")
    lists = steps.where("place >= 0").groupBy().applyInPandas(chain, "block bigint, slot bigint, value string")
    found = steps.where("place < 0").join(lists.withColumnRenamed("value", "_listed"), ["block", "slot"], "left")
    return found.select(rn, F.when(F.col("slot") < 0, F.col("value")).otherwise(F.col("_listed")).alias(column))


# Symbol tables


def _count_symbols(texts: Iterator[bytes], table: list[bytes], longest: int) -> Counter[bytes]:
    """Occurrences of what ``table`` cuts the texts to, and of neighbours put together."""
    counts: Counter[bytes] = Counter()
    pairs: Counter[tuple[bytes, bytes]] = Counter()
    cut = _cutter(table)
    for t in texts:
        tokens = cut(t)
        counts.update(tokens)
        pairs.update(zip(tokens, tokens[1:]))
    for (a, b), n in pairs.items():
        if len(a) + len(b) <= longest:
            counts[a + b] += n
    return counts


def _best_symbols(counts: Counter[bytes], most: int) -> list[bytes]:
    """The ``most`` with the largest count * length; longer, then smaller, ones first among equals."""
    return [s for s, _ in sorted(counts.items(), key=lambda x: (-x[1] * len(x[0]), -len(x[0]), x[0]))[:most]]


def train_symbols(texts: list[bytes], rounds: int = 5, most: int = 255, longest: int = 8) -> list[bytes]:
    """Symbols of up to ``longest`` bytes that save most: in each round the texts are cut
    greedily, tokens and neighbouring pairs are counted, and the best stay."""
    table: list[bytes] = []
    for _ in range(rounds):
        table = _best_symbols(_count_symbols(iter(texts), table, longest), most)
    return table


def _cutter(table: list[bytes]) -> Callable[[bytes], list[bytes]]:
    """Cuts bytes to the longest symbols at each place, single bytes where there is none."""
    rest: dict[int, list[bytes]] = {}
    for s in sorted(table, key=lambda s: -len(s)):
        rest.setdefault(s[0], []).append(s[1:])
    each = [re.escape(bytes([c])) + b"(?:" + b"|".join([*map(re.escape, r), b""]) + b")" for c, r in rest.items()]
    return re.compile(b"|".join([*each, b"."]), re.DOTALL).findall


def _spread(df: DataFrame) -> DataFrame:
    """A small file is one partition, whatever its rows cost in Python."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def train_symbol_table(df: DataFrame, column: str, rounds: int = 5, most: int = 255, longest: int = 8) -> list[bytes]:
    """As :func:`train_symbols` over the whole column: a round's table is broadcast, counted with
    in the executors, and the counts' best are the next.

    A round has at most 256 + 255 tokens, so at most 2^18 counts a task; only the best of
    their sums reach the driver.
    """
    table: list[bytes] = []
    values = _spread(df.where(F.col(column).isNotNull()).select(F.col(column).cast("binary").alias("v")))
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], table: list[bytes] = table) -> Iterator[pa.RecordBatch]:
            counts: Counter[bytes] = Counter()
            for b in batches:
                counts.update(_count_symbols(iter(b.column(0).to_pylist()), table, longest))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])

        summed = values.mapInArrow(count, "s binary, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
        best = summed.orderBy(F.desc(F.col("n") * F.octet_length("s")), F.desc(F.octet_length("s")), "s").limit(most).collect()  # bounded
        table = _best_symbols(Counter({bytes(r["s"]): r["n"] for r in best}), most)
    return table


@dataclass(frozen=True)
class SymbolTable:
    """A trained table that can be kept and used for columns to come."""

    symbols: tuple[bytes, ...]

    @classmethod
    def train(cls, df: DataFrame, column: str) -> SymbolTable:
        return cls(tuple(train_symbol_table(df, column)))

    def to_bytes(self) -> bytes:
        """The number of symbols, then each one's length and bytes."""
        return bytes([len(self.symbols)]) + b"".join(bytes([len(s)]) + s for s in self.symbols)

    @classmethod
    def from_bytes(cls, raw: bytes) -> SymbolTable:
        symbols, at = [], 1
        for _ in range(raw[0]):
            end = at + 1 + raw[at]
            if raw[at] == 0 or end > len(raw):
                raise InvalidPatchError("a symbol table is cut short")
            symbols.append(raw[at + 1 : end])
            at = end
        if at != len(raw):
            raise InvalidPatchError("bytes after a symbol table")
        return cls(tuple(symbols))

    def encode(self, df: DataFrame, column: str, out: str = "packed") -> DataFrame:
        return symbol_encode(df, column, list(self.symbols), out)

    def decode(self, df: DataFrame, packed: str, out: str) -> DataFrame:
        return symbol_decode(df, packed, list(self.symbols), out)


def symbol_encode(df: DataFrame, column: str, table: list[bytes], out: str = "packed") -> DataFrame:
    """Add ``out``: a byte for each symbol, 255 before a byte that no symbol covers; null for null."""
    code = {bytes([c]): bytes([255, c]) for c in range(256)} | {s: bytes([i]) for i, s in enumerate(table)}
    cut = _cutter(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(b.schema.get_field_index(column)).to_pylist():
                got.append(None if t is None else b"".join(map(code.__getitem__, cut(t.encode()))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, out])

    return _spread(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def symbol_decode(df: DataFrame, packed: str, table: list[bytes], out: str) -> DataFrame:
    text = {bytes([255, c]): bytes([c]) for c in range(256)} | {bytes([i]): s for i, s in enumerate(table)}
    cut = re.compile(rb"\xff.|.", re.DOTALL).findall

    def back(raw: bytes) -> str:
        return b"".join(map(text.__getitem__, cut(raw))).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None else back(x) for x in b.column(b.schema.get_field_index(packed)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


# Profiles


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each column: n, present, distinct, lo, hi (as text), bytes (of strings), constant."""
    parts = []
    for name in columns or df.columns:
        c = F.col(f"`{name}`")
        text = isinstance(df.schema[name].dataType, T.StringType)
        size = F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) if text else F.lit(None).cast("bigint")
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("present"), F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi"), size.cast("bigint").alias("bytes")).select(F.lit(name).alias("column"), "*", (F.col("distinct") == 1).alias("constant")))
    return _union(parts)


INTEGER_CODECS = ("raw", "frame_of_reference", "delta", "run_length", "dictionary", "patched")
FLOAT_CODECS = ("raw", "decimal", "xor", "xor_window", "real_double")


def integer_costs(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row: n, runs, kinds, and the predicted bytes of each of ``INTEGER_CODECS``."""
    c = df.select(rn, _bits(df, column).alias("v"), F.col(column).alias("given"))
    c = with_previous(c, {"p": "v"}, rn)
    d = wrapping_sub(F.col("v"), F.col("p"))
    s = c.agg(
        F.count(F.lit(1)).alias("n"), bit_length(wrapping_sub(_bits(df, column, F.max("given")), _bits(df, column, F.min("given")))).alias("bits"), F.min(d).alias("dlo"), F.max(d).alias("dhi"),
        F.count_if(F.col("p").isNull() | (F.col("p") != F.col("v"))).alias("runs"), F.count_distinct("v").alias("kinds"),
        F.sum(F.when(F.col("p").isNull() | (F.col("p") != F.col("v")), varint_length(zigzag(F.col("v"))) + 1)).alias("run_bytes"),
    )
    bits = lambda w: F.ceil(F.col("n") * w / 8).cast("bigint")
    big = F.lit(1 << 60)
    return s.crossJoin(patched_width(df, column).select(F.col("cost").alias("_patched"))).select(  # a row each
        "n", "runs", "kinds", (F.col("n") * 8).alias("raw"),
        (bits(F.col("bits")) + 10).alias("frame_of_reference"),
        F.when(F.col("n") >= 4, bits(bit_length(wrapping_sub(F.col("dhi"), F.col("dlo")))) + 20).otherwise(big).alias("delta"),
        F.when(F.col("n") >= 8, F.col("run_bytes")).otherwise(big).cast("bigint").alias("run_length"),
        F.when((F.col("n") >= 8) & (F.col("kinds") <= MOST_CODES), F.col("kinds") * 8 + bits(index_width(F.col("kinds")))).otherwise(big).alias("dictionary"),
        (F.col("_patched") + 12).alias("patched"),
    )


def _cheapest(costs: DataFrame, name: str, codecs: tuple[str, ...]) -> DataFrame:
    least = F.least(*codecs)
    return costs.select(F.lit(name).alias("column"), F.coalesce(*[F.when(F.col(x) == least, F.lit(x)) for x in codecs]).alias("encoding"), least.alias("bytes"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommend(df: DataFrame, *columns: str, rn: str = "rn") -> DataFrame:
    """(column, encoding, bytes): the cheapest encoding of each integer column; the first of equals."""
    return _union([_cheapest(integer_costs(df, name, rn), name, INTEGER_CODECS) for name in columns])


def float_costs(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row: n and the predicted bytes of each of ``FLOAT_CODECS``, of doubles or floats without nulls."""
    size, d = _width(df, column), decimal_exponent(df, column).first()
    n, ref = d["n"], (128).bit_length() - 1
    m = decimal_encode(df, column, d["exponent"], rn)
    width = m.agg(bit_length(wrapping_sub(F.max("mantissa"), F.min("mantissa"))).alias("w"))
    one = lambda meaningful: F.sum(F.when(meaningful == 0, 1).otherwise(meaningful + 13))
    x = xor_encode(df, column, rn).agg(one(F.col("meaningful")).alias("x"))
    trailing = F.length(F.regexp_extract(F.bin("xor"), "0*$", 0))
    y = xor_window_encode(df, column, rn).agg((one(F.when(F.col("xor") != 0, bit_length(F.col("xor")) - trailing).otherwise(0)) + F.lit(ref * n)).alias("y"))
    z = real_double_encode(df, column, rn).agg(F.sum(F.col("cut") + 3 + F.when(F.col("code") < 0, size - F.col("cut") + 16).otherwise(0)).alias("z"))
    decimal = F.ceil(F.lit(n) * F.col("w") / 8) + F.lit(d["exceptions"] * (2 + size // 8) + 10)
    octets = lambda c: F.ceil(F.col(c) / 8).cast("bigint")
    return width.crossJoin(x).crossJoin(y).crossJoin(z).select(F.lit(n).alias("n"), F.lit(n * size // 8).alias("raw"), decimal.cast("bigint").alias("decimal"), octets("x").alias("xor"), octets("y").alias("xor_window"), octets("z").alias("real_double"))  # a row each


def recommend_floats(df: DataFrame, *columns: str, rn: str = "rn") -> DataFrame:
    """(column, encoding, bytes): the cheapest encoding of each column of doubles or floats."""
    return _union([_cheapest(float_costs(df, name, rn), name, FLOAT_CODECS) for name in columns])


def layout_probe(df: DataFrame, *columns: str, rn: str = "rn") -> DataFrame:
    """One row: predicted bytes of integer and text columns row by row and column by column, and
    whether columns gain ten percent."""
    row, col = None, None
    for name in columns:
        if isinstance(df.schema[name].dataType, T.StringType):
            c = df.agg((F.sum(F.octet_length(name) + 1)).alias("r"), F.count_distinct(name).alias("k"), F.count(name).alias("n"), F.sum(F.octet_length(name)).alias("b")).select("r", F.least(F.col("b") + F.col("n"), F.ceil(F.col("n") * index_width(F.col("k")) / 8) + F.col("k") * F.ceil(F.col("b") / F.col("n"))).cast("bigint").alias("c"))
        else:
            least = F.least(*INTEGER_CODECS)
            c = integer_costs(df, name, rn).crossJoin(df.agg(F.sum(varint_length(zigzag(F.col(name))) + 1).alias("r"))).select("r", least.alias("c"))
        r = c.first()  # one row
        row, col = (row or 0) + r["r"], (col or 0) + r["c"]
    return df.sparkSession.createDataFrame([(row, col, col * 10 <= row * 9)], "row_bytes bigint, column_bytes bigint, columnar boolean")


#: Writer options by preset: speed, balance, size.
PRESETS = {
    "speed": {"compression": "none", "parquet.writer.version": "v1"},
    "balanced": {"compression": "snappy", "parquet.enable.dictionary": "true"},
    "compression": {"compression": "zstd", "parquet.writer.version": "v2"},
}


