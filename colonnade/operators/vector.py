"""Lossy vectors under a fidelity budget, distances, exact neighbours, and recall.

Native column expressions where they do; the rotation and the E8 lattice run on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import copied, meet, pack_blocks

LEAST_DIMS = 32
_INT32 = 2**31 - 1
#: Second moment of the unit interval, and of the E8 lattice's cell by dimension (fixed values).
SCALAR_MOMENT = 1.0 / 12.0
E8_MOMENT = 0.0716821


# Native expressions


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-30)


def relative_error(v: Column, w: Column) -> Column:
    return F.sqrt(squared_distance(v, w) / (dot(v, v) + 1e-30))


def unit(v: Column) -> Column:
    """The direction; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def polar(v: Column) -> Column:
    return F.struct(norm(v).alias("norm"), unit(v).alias("direction"))


def rms(df: DataFrame, column: str) -> DataFrame:
    """One row ``sigma``: the root mean square of all components."""
    return df.select(F.explode(column).alias("x")).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))).alias("sigma"))


def quantize(v: Column, step: Column) -> Column:
    """Components divided by ``step``, rounded half to even; saturated at 32 bits."""
    return F.transform(v, lambda x: F.least(F.greatest(F.rint(x.cast("double") / step), F.lit(-float(_INT32))), F.lit(float(_INT32))).cast("int"))


def saturated(v: Column, step: Column) -> Column:
    return F.exists(v, lambda x: F.abs(F.rint(x.cast("double") / step)) > _INT32)


def reconstruct(q: Column, step: Column) -> Column:
    return F.transform(q, lambda x: x * step)


def exceptions(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, idx, value) of components that are NaN or infinite, which no quantizer takes."""
    return df.select(key, F.posexplode(column).alias("idx", "value")).where(F.isnan("value") | (F.abs("value") == math.inf))


def uniform_quantize(df: DataFrame, column: str, bits: int = 8) -> DataFrame:
    """Add ``q`` and ``back``: a grid between each vector's least and largest component."""
    lo, hi = F.array_min(column).cast("double"), F.array_max(column).cast("double")
    step = (hi - lo) / ((1 << bits) - 1)
    q = F.transform(column, lambda x: F.when(step > 0, F.rint((x.cast("double") - lo) / step)).otherwise(0.0).cast("int"))
    return df.withColumn("q", q).withColumn("back", F.transform("q", lambda x: lo + x * step))


# Budgets


@dataclass(frozen=True)
class Budget:
    """What a reconstruction must keep: max_rel_error, min_cosine or target_snr (dB)."""

    kind: str
    value: float

    def step(self, sigma: float, moment: float = SCALAR_MOMENT) -> float:
        if self.kind == "max_rel_error":
            return sigma * self.value / math.sqrt(moment)
        if self.kind == "min_cosine":
            return sigma * math.sqrt(2 * (1 - self.value) / moment)
        return sigma / math.sqrt(moment) * 10 ** (-self.value / 20)

    def met(self, worst_cosine: float, worst_error: float) -> bool:
        if self.kind == "min_cosine":
            return worst_cosine >= self.value
        return worst_error <= (self.value if self.kind == "max_rel_error" else 10 ** (-self.value / 20))


def max_rel_error(eps: float) -> Budget:
    return Budget("max_rel_error", eps)


def min_cosine(c: float = 0.999) -> Budget:
    return Budget("min_cosine", c)


def target_snr(db: float) -> Budget:
    return Budget("target_snr", db)


def quality(df: DataFrame, original: str, back: str) -> DataFrame:
    """One row: worst_cosine, worst_error, mean_error."""
    return df.agg(F.min(cosine(F.col(original), F.col(back))).alias("worst_cosine"), F.max(relative_error(F.col(original), F.col(back))).alias("worst_error"), F.avg(relative_error(F.col(original), F.col(back))).alias("mean_error"))


@dataclass(frozen=True)
class Encoded:
    """``rows``: the table with ``q``; ``step`` None where vectors are kept as they are."""

    rows: DataFrame
    step: float | None
    lattice: str


def encode(df: DataFrame, column: str, budget: Budget = min_cosine(), tries: int = 4) -> Encoded:
    """Scalar quantization that meets the budget for every vector, else no quantization.

    The step starts at the budget's closed form and shrinks to 0.6 of itself while the worst
    vector misses it.  Vectors under 32 components and steps that would saturate stay lossless.
    """
    small = df.where(F.size(column) < LEAST_DIMS).limit(1).count()
    sigma = None if small else rms(df, column).first()["sigma"]
    if not sigma:
        return Encoded(df, None, "lossless")
    step = budget.step(sigma)
    for _ in range(tries):
        s = F.lit(step)
        rows = df.withColumn("q", quantize(F.col(column), s))
        if df.where(saturated(F.col(column), s)).limit(1).count():
            break
        r = quality(rows.withColumn("_back", reconstruct(F.col("q"), s)), column, "_back").first()
        if budget.met(r["worst_cosine"], r["worst_error"]):
            return Encoded(rows, step, "scalar")
        step *= 0.6
    return Encoded(df, None, "lossless")


def decode(encoded: Encoded, column: str, out: str = "back") -> DataFrame:
    if encoded.step is None:
        return encoded.rows.withColumn(out, F.transform(column, lambda x: x.cast("double")))
    return encoded.rows.withColumn(out, reconstruct(F.col("q"), F.lit(encoded.step)))


# Rotation and lattice


def hadamard(x: np.ndarray, seed: int = 1, inverse: bool = False) -> np.ndarray:
    """Rows turned by random signs and a normalized Walsh-Hadamard transform, their width a power of two."""
    n = x.shape[1]
    signs = np.random.default_rng([seed, n]).integers(0, 2, n) * 2.0 - 1.0
    y = x.copy() if inverse else x * signs
    h = 1
    while h < n:
        y = y.reshape(len(x), n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    y = y / math.sqrt(n)
    return y * signs if inverse else y


def padded(x: np.ndarray) -> np.ndarray:
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, n - x.shape[1])))


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (integers with an even sum, or those moved by one half) to rows of eight."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        # the component rounded farthest goes the other way
        d = y[odd] - r[odd]
        k = np.abs(d).argmax(axis=1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    near_a = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near_a[:, None], a, b)


def _vector_map(df: DataFrame, column: str, out: str, fn) -> DataFrame:
    """Add ``out``: ``fn`` over each batch's vectors (of one length each time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index(column)).to_pylist()
            got: list = [None] * len(rows)
            for n in {len(r) for r in rows if r}:
                at = [i for i, r in enumerate(rows) if r is not None and len(r) == n]
                for i, v in zip(at, fn(np.array([rows[i] for i in at], np.float64)).tolist()):
                    got[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def rotate(df: DataFrame, column: str, out: str = "rotated", seed: int = 1) -> DataFrame:
    return _vector_map(df, column, out, lambda x: hadamard(padded(x), seed))


def unrotate(df: DataFrame, column: str, dims: int, out: str = "unrotated", seed: int = 1) -> DataFrame:
    return _vector_map(df, column, out, lambda x: hadamard(x, seed, inverse=True)[:, :dims])


def e8_quantize(df: DataFrame, column: str, step: float, out: str = "e8", seed: int = 1) -> DataFrame:
    """Vectors rotated, rounded to step times E8 in groups of eight, and turned back."""

    def fn(x: np.ndarray) -> np.ndarray:
        y = hadamard(padded(np.pad(x, ((0, 0), (0, max(0, 8 - x.shape[1]))))), seed)
        z = nearest_e8(y.reshape(-1, 8) / step).reshape(y.shape) * step
        return hadamard(z, seed, inverse=True)[:, : x.shape[1]]

    return _vector_map(df, column, out, fn)


def rotated_scalar(df: DataFrame, column: str, step: float, out: str = "back", seed: int = 1) -> DataFrame:
    """Vectors rotated, rounded to multiples of ``step``, and turned back."""
    return _vector_map(df, column, out, lambda x: hadamard(np.rint(hadamard(padded(x), seed) / step) * step, seed, inverse=True)[:, : x.shape[1]])


def _books(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(x, parts, axis=1)


def _nearest_code(piece: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((piece[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def train_codebooks(df: DataFrame, column: str, parts: int = 8, codes: int = 16, rounds: int = 12) -> list[np.ndarray]:
    """``parts`` tables of ``codes`` centroids by k-means over all vectors.

    It begins with the ``codes`` vectors of the smallest hashes; in each round tasks sum the vectors
    nearest to each centroid, and only the sums' totals reach the driver.
    """
    given = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    first = given.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(codes).toArrow().column(0).to_pylist()  # bounded
    books = _books(np.array(first, np.float64), parts)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            total, n = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for b in batches:
                lists = b.column(0)
                for i in range(0, len(lists), 2048):
                    rows = lists.slice(i, 2048)
                    x = np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)
                    for p, piece in enumerate(_books(x, parts)):
                        code = _nearest_code(piece, books[p])
                        np.add.at(total[p], code, piece)
                        n[p] += np.bincount(code, minlength=len(n[p]))
            cells = [(p, c, d, int(n[p][c]), float(total[p][c, d])) for p in range(len(books)) for c in range(len(books[p])) if n[p][c] for d in range(books[p].shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))], names=["p", "c", "d", "n", "s"])

        got = given.mapInArrow(sums, "p int, c int, d int, n bigint, s double").groupBy("p", "c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a number per component of a centroid
        books = [b.copy() for b in books]
        for r in got:
            books[r["p"]][r["c"], r["d"]] = r["s"] / r["n"]
    return books


def product_quantize(df: DataFrame, column: str, parts: int = 8, codes: int = 16, out: str = "back", books: list[np.ndarray] | None = None) -> DataFrame:
    """Add ``out``: each of ``parts`` pieces of a vector replaced by its nearest centroid (of ``books``,
    or trained on the column)."""
    books = train_codebooks(df, column, parts, codes) if books is None else books

    def fn(x: np.ndarray) -> np.ndarray:
        return np.concatenate([b[_nearest_code(p, b)] for p, b in zip(_books(x, len(books)), books)], axis=1)

    return _vector_map(df, column, out, fn)


# Neighbours


def exact_knn(df: DataFrame, key: str, column: str, k: int = 10, queries: DataFrame | None = None, shard_rows: int = 8192, block_rows: int = 128) -> DataFrame:
    """(query, rank, neighbor, dist2): the ``k`` nearest of all rows by squared distance to each of
    ``queries`` (rows of the same columns; all of ``df`` if not given); ties to the smaller key, the row
    itself left out.

    Blocks of queries pass by shards of rows; each keeps ``k`` for a query, and these are ranked
    once more.
    """

    def near(held: tuple, asked: tuple) -> pa.RecordBatch:
        (own, x), (ids, qs) = held, asked
        out: list[list] = [[], [], []]
        squares = (x**2).sum(axis=1)
        rough = squares[None, :] + (qs**2).sum(axis=1)[:, None] - 2 * qs @ x.T
        slack = 1e-9 * (1 + squares.max() + float((qs**2).sum(axis=1).max()))
        for q, v, r in zip(ids.tolist(), qs, rough):
            # the product only picks what is measured
            at = np.flatnonzero(r <= np.partition(r, k)[k] + slack) if len(r) > k + 1 else np.arange(len(r))
            at = at[own[at] != q]
            d = ((x[at] - v) ** 2).sum(axis=1)
            order = np.lexsort((own[at], d))[:k]
            out[0] += [q] * len(order)
            out[1] += own[at[order]].tolist()
            out[2] += d[order].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query", "neighbor", "dist2"])

    held, shards = pack_blocks(df, key, column, shard_rows)
    asked, _ = pack_blocks(df if queries is None else queries, key, column, block_rows)
    found = meet(held, copied(asked, shards), ["block"], shards, near, "query bigint, neighbor bigint, dist2 double")
    w = Window.partitionBy("query").orderBy("dist2", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbor", "dist2")


def recall(truth: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """One row ``recall``: the mean share of the true neighbours that were found."""
    hits = truth.select("query", "neighbor").join(found.select("query", "neighbor"), ["query", "neighbor"], "left_semi").groupBy("query").count()
    return truth.select("query").distinct().join(hits, "query", "left").agg((F.avg(F.coalesce("count", F.lit(0))) / k).alias("recall"))


def grouped_encode(df: DataFrame, group: str, column: str, budget: Budget = min_cosine(), tries: int = 4, least_rows: int = 16, part_rows: int = 16_384) -> DataFrame:
    """Add ``back``, ``lattice`` and ``bits`` (of a vector's codes by their entropy, without its norm):
    each group of equally long vectors encoded by itself.

    A group of over ``part_rows`` rows is encoded in parts of about that many, by a hash of the vector,
    each with a step and lattice of its own.

    Norms are kept apart and directions are rotated; from 16 padded dimensions on and for a tight
    budget the E8 lattice is tried against the scalar grid, and the one with the fewer bits by
    its entropy taken.  Groups that are too small, or whose budget isn't met, stay as they are.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[column].tolist()
        out = pdf.copy()
        lens = {None if r is None else len(r) for r in rows}
        out["back"], out["lattice"] = [None if r is None else [float(v) for v in r] for r in rows], "lossless"
        out["bits"] = [None if r is None else 64.0 * len(r) for r in rows]
        if len(rows) < least_rows or len(lens) != 1 or None in lens or next(iter(lens)) < LEAST_DIMS:
            return out
        x = np.array(rows, np.float64)
        if not np.isfinite(x).all():
            return out
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        y = hadamard(padded(np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)))
        best = None
        for lattice, moment in (("scalar", SCALAR_MOMENT), ("e8", E8_MOMENT)):
            step = budget.step(math.sqrt((y**2).mean()), moment)
            for _ in range(tries):
                q = np.rint(y / step) if lattice == "scalar" else nearest_e8(y.reshape(-1, 8) / step).reshape(y.shape)
                back = hadamard(q * step, inverse=True)[:, : x.shape[1]] * norms
                cos = (x * back).sum(axis=1) / (norms[:, 0] * np.linalg.norm(back, axis=1) + 1e-30)
                rel = np.sqrt(((x - back) ** 2).sum(axis=1) / ((x**2).sum(axis=1) + 1e-30))
                if budget.met(float(cos[norms[:, 0] > 0].min(initial=1.0)), float(rel.max())):
                    _, n = np.unique(q, return_counts=True)
                    p = n / n.sum()
                    bits = float(-(p * np.log2(p)).sum()) * q.size
                    if best is None or bits < best[0]:
                        best = (bits, lattice, back)
                    break
                step *= 0.6
        if best is not None:
            out["back"], out["lattice"], out["bits"] = best[2].tolist(), best[1], best[0] / len(rows)
        return out

    schema = T.StructType([*df.schema.fields, T.StructField("back", T.ArrayType(T.DoubleType())), T.StructField("lattice", T.StringType()), T.StructField("bits", T.DoubleType())])
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    part, names = F.pmod(F.xxhash64(column), F.col("_parts")).cast("int"), df.columns
    return df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_part", part).groupBy(group, "_part").applyInPandas(lambda pdf: one(pdf[names]), schema)
