"""Small scalar helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes of the longest common prefix, at a character border; null if either is null."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != ""))
    # the first place that differs; equal up to the shorter one's end otherwise
    stop = F.array_position(F.transform(chars, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(chars)).cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.octet_length(F.substr(a, F.lit(1), n)))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ...; of 64-bit integers."""
    return F.shiftleft(x.cast("bigint"), 1).bitwiseXOR(F.shiftright(x.cast("bigint"), 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x.cast("bigint"), 1).bitwiseXOR(-(x.cast("bigint").bitwiseAND(F.lit(1))))


_DECIMAL = "decimal(38,0)"
_TWO_64 = "18446744073709551616"


def _wrapped(x: Column) -> Column:
    """A decimal modulo 2^64, as a signed 64-bit integer."""
    low = F.pmod(x, F.lit(_TWO_64).cast(_DECIMAL))
    return F.when(low >= F.lit("9223372036854775808").cast(_DECIMAL), low - F.lit(_TWO_64).cast(_DECIMAL)).otherwise(low).cast("bigint")


def low_half(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def from_halves(lo: Column, hi: Column) -> Column:
    """hi * 2^32 + lo modulo 2^64, of sums and differences of halves."""
    return F.shiftleft(hi + F.shiftright(lo, 32), 32).bitwiseOR(low_half(lo))


def wrapping_sub(a: Column, b: Column) -> Column:
    """a - b of 64-bit integers modulo 2^64, by halves: an overflow that is caught costs an exception for each row."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return from_halves(low_half(a) - low_half(b), F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32))


def wrapping_add(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return from_halves(low_half(a) + low_half(b), F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32))


def uint_bits(x: Column) -> Column:
    """The 64 bits of an unsigned integer, a decimal(20,0), as a bigint."""
    return _wrapped(x.cast(_DECIMAL))


def from_uint_bits(x: Column) -> Column:
    return F.when(x < 0, x.cast(_DECIMAL) + F.lit(_TWO_64).cast(_DECIMAL)).otherwise(x.cast(_DECIMAL)).cast("decimal(20,0)")


def bit_length(x: Column) -> Column:
    """Bits of a 64-bit integer read without sign; 0 for 0 and null."""
    return F.when(x != 0, F.length(F.bin(x.cast("bigint")))).otherwise(F.lit(0))


def index_width(distinct: Column) -> Column:
    """Bits that tell ``distinct`` codes apart; 0 for one."""
    return bit_length(F.greatest(distinct - 1, F.lit(0).cast("bigint")))


def next_power_of_two(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_length(x - 1).cast("int")))


def varint_length(x: Column) -> Column:
    """Bytes of a 64-bit integer, read without sign, in groups of seven bits."""
    return F.greatest(F.ceil(bit_length(x) / 7).cast("int"), F.lit(1))


def unix_parts(ts: Column) -> Column:
    """(sec, nsec) of a timestamp, one without zone read in the session's."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.struct(F.floor(us / 1_000_000).cast("bigint").alias("sec"), (F.pmod(us, F.lit(1_000_000)) * 1000).cast("bigint").alias("nsec"))


def from_unix_parts(parts: Column) -> Column:
    return F.timestamp_micros(parts["sec"] * 1_000_000 + F.floor(parts["nsec"] / 1000).cast("bigint"))
