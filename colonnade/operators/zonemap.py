"""Zones of 256 rows with minima and maxima, pruning by them, and a learned linear zone map."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError
from ..functions.predicate import GT, LT, WhereCmp, WhereRange
from ..functions.scalar import uint_bits, varint_length, zigzag
from ..schema import kind_of
from .order import with_previous

ZONE = 256
LEAST_ROWS = 512


def zone_of(rn: str = "rn") -> Column:
    return F.floor(F.col(rn) / ZONE).cast("bigint")


def eligible(df: DataFrame, column: str) -> None:
    """Zones are for integer, unsigned and double columns without nulls."""
    kind = kind_of(df.schema[column].dataType)
    if kind not in ("int", "uint", "float64"):
        raise TypeMismatchError("zones", column, "int, uint or float64", kind)


def worth_zones(df: DataFrame, column: str) -> bool:
    """Whether the column is eligible and has the rows of two zones at least, and no null."""
    eligible(df, column)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("present")).first()
    return r["n"] >= LEAST_ROWS and r["present"] == r["n"]


def build_if_worth(df: DataFrame, column: str, rn: str = "rn") -> DataFrame | None:
    """Zones, or None for a column that has none: its queries read all of it."""
    return build(df, column, rn) if worth_zones(df, column) else None


def build(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """(zone, n, zmin, zmax) of a numbered table.

    NaNs don't count; a zone of NaNs alone has the empty interval (+Inf, -Inf).
    """
    eligible(df, column)
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.DoubleType):
        v = F.when(~F.isnan(c), c)
        lo, hi = F.coalesce(F.min(v), F.lit(math.inf)), F.coalesce(F.max(v), F.lit(-math.inf))
    else:
        lo, hi = F.min(c), F.max(c)
    return df.groupBy(zone_of(rn).alias("zone")).agg(F.count(F.lit(1)).alias("n"), lo.alias("zmin"), hi.alias("zmax"))


def bounds(test: WhereCmp | WhereRange) -> tuple[object, object] | None:
    """(lo, hi) outside which the test can't hold, None being open; None if it never holds."""
    if isinstance(test, WhereRange):
        lo, hi = test.lo, test.hi
    else:
        mask, v = test.op & 7, test.value
        if not mask:
            return None
        # a side is open if values on it pass; NE and ALWAYS are open on both
        lo, hi = None if mask & LT else v, None if mask & GT else v
        if mask == 7:
            return lo, hi
        if _is_nan(v):
            return None
    return None if _is_nan(lo) or _is_nan(hi) else (lo, hi)


def _is_nan(v: object) -> bool:
    return v is not None and v != v


def may_hold(test: WhereCmp | WhereRange, zmin: str = "zmin", zmax: str = "zmax") -> Column:
    """Whether a zone can have a row that passes the test."""
    at = bounds(test)
    if at is None:
        return F.lit(False)
    lo, hi = at
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col(zmax) >= F.lit(lo))
    if hi is not None:
        out = out & (F.col(zmin) <= F.lit(hi))
    return out


def prune(df: DataFrame, zones: DataFrame | None, test: WhereCmp | WhereRange, rn: str = "rn") -> DataFrame:
    """Rows that pass ``test``, looked for in zones that may hold them only; in all rows without ``zones``."""
    if zones is None:
        return df.where(test.lower(df.schema))
    kept = zones.where(may_hold(test)).select("zone")
    return df.withColumn("zone", zone_of(rn)).join(kept, "zone", "left_semi").where(test.lower(df.schema)).drop("zone")


def matched_zones(df: DataFrame, zones: DataFrame, test: WhereCmp | WhereRange, rn: str = "rn") -> DataFrame:
    """(zone): zones with a row that passes, which are all that a projection has to read."""
    return prune(df, zones, test, rn).select(zone_of(rn).alias("zone")).distinct()


def skip_stats(zones: DataFrame, test: WhereCmp | WhereRange) -> DataFrame:
    """One row: zones, and how many of them the test skips."""
    return zones.agg(F.count(F.lit(1)).alias("zones"), F.count_if(~may_hold(test)).alias("skipped"))


@dataclass(frozen=True)
class LinearZones:
    """place ~ slope * value + offset, off by ``error`` rows at most, over ``rows`` rows."""

    slope: float
    offset: float
    error: int
    rows: int

    def places(self, lo: float, hi: float) -> tuple[int, int] | None:
        """First and last row that a value from lo to hi can have; None if none can."""
        first, last = self.slope * lo + self.offset - self.error, self.slope * hi + self.offset + self.error
        if not (last >= 0 and first <= self.rows - 1):  # so that a NaN has none
            return None
        # cut to the table before turning to integers
        return int(math.floor(min(max(first, 0.0), self.rows - 1.0))), int(math.floor(min(max(last, 0.0), self.rows - 1.0)))

    def zones(self, lo: float, hi: float) -> tuple[int, int] | None:
        at = self.places(lo, hi)
        return None if at is None else (at[0] // ZONE, at[1] // ZONE)


#: Bytes of a model: two doubles and the error's varint (2 at most, as it is 256 at most).
MODEL_BYTES = 18


def index_bytes(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row ``bytes``: of the zones' minima and maxima, as varints of zigzags (unsigned: as they are)."""
    unsigned = kind_of(df.schema[column].dataType) == "uint"
    size = lambda c: varint_length(uint_bits(F.col(c)) if unsigned else zigzag(F.col(c)))
    return build(df, column, rn).agg(F.sum(size("zmin") + size("zmax")).cast("bigint").alias("bytes"))


def linear_model(df: DataFrame, column: str, rn: str = "rn") -> DataFrame:
    """One row: n, sorted, slope, offset, error, index_bytes, accepted.

    Accepted are ascending integer columns with a finite positive slope, an error of 256 at most,
    and an index of minima and maxima that takes more bytes than the model.
    """
    eligible(df, column)
    x, y = F.col(f"`{column}`").cast("double"), F.col(rn).cast("double")
    ordered = with_previous(df, {"_prev": column}, rn).agg(F.coalesce(F.bool_and(F.col("_prev").isNull() | (F.col("_prev") <= F.col(f"`{column}`"))), F.lit(True)).alias("sorted"))
    n, sx, sy, sxy, sxx = F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x)
    fit = df.agg(n.cast("double").alias("n"), sx.alias("sx"), sy.alias("sy"), sxy.alias("sxy"), sxx.alias("sxx"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    fit = fit.withColumn("den", den).withColumn("slope", F.when(F.col("den") > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.col("den")))
    fit = fit.withColumn("offset", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    model = fit.select("n", "slope", "offset")
    off = df.crossJoin(F.broadcast(model)).agg(F.max(F.abs(y - (F.col("slope") * x + F.col("offset")))).alias("off"))  # one row
    whole = kind_of(df.schema[column].dataType) in ("int", "uint")
    size = index_bytes(df, column, rn) if whole else df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("bytes"))
    finite = F.when(~F.isnan("off") & (F.col("off") < 2.0**53), F.col("off"))  # else there is no error to speak of
    out = model.crossJoin(ordered).crossJoin(off).crossJoin(size).withColumn("error", (F.ceil(finite) + 1).cast("bigint"))
    ok = F.lit(whole) & F.col("sorted") & (F.col("slope") > 0) & (F.col("slope") < math.inf) & (F.col("error") <= ZONE) & (F.col("bytes") > MODEL_BYTES)
    return out.select(F.col("n").cast("bigint").alias("n"), "sorted", "slope", "offset", "error", F.col("bytes").alias("index_bytes"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def learn_linear(df: DataFrame, column: str, rn: str = "rn") -> LinearZones | None:
    r = linear_model(df, column, rn).first()
    return LinearZones(r["slope"], r["offset"], r["error"], r["n"]) if r["accepted"] else None


def prune_linear(df: DataFrame, model: LinearZones, test: WhereRange, rn: str = "rn") -> DataFrame:
    """As :func:`prune`, by the learned model."""
    got = model.zones(float(test.lo), float(test.hi))
    if got is None:
        return df.where(F.lit(False))
    return df.where((F.col(rn) >= got[0] * ZONE) & (F.col(rn) < (got[1] + 1) * ZONE)).where(test.lower(df.schema))
