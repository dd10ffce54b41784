"""Operator 8: near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors again and again at a threshold on a random direction;
vectors within ``spill`` of a threshold go to both sides.  Vectors that share a leaf of
any tree are compared, those whose cosine reaches the limit are linked, and links are
united into components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import written


@dataclass(frozen=True)
class Tree:
    """Node i: direction, threshold, children; a leaf's left child is -1 - its number."""

    directions: np.ndarray
    thresholds: np.ndarray
    left: np.ndarray
    right: np.ndarray


def grow(sample: np.ndarray, share: float, leaf_rows: int, spill: float, rng: np.random.Generator, least: int = 16, tries: int = 8) -> Tree:
    """A tree over unit vectors ``sample``, each of which stands for 1/share rows.

    A node is split while it stands for more than ``leaf_rows`` rows and holds ``least``
    sample vectors.  Of several thresholds between the quartiles of each of several directions
    the one with the fewest vectors in its spill zone is taken; if even that zone holds a
    third of the node - a cluster narrower than the zone - the node stays a leaf.
    """
    dims = sample.shape[1] if sample.ndim == 2 else 0
    dirs, cuts, left, right = [], [], [], []
    leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        me = len(left)
        for column, v in ((dirs, np.zeros(dims, np.float32)), (cuts, 0.0), (left, 0), (right, 0)):
            column.append(v)
        if len(rows) / share > leaf_rows and len(rows) >= least:
            d = rng.standard_normal((tries, dims)).astype(np.float32)
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            p = np.sort(sample[rows] @ d.T, axis=0)
            at = np.linspace(len(rows) // 4, 3 * len(rows) // 4, 9).astype(int)
            worth = [(np.searchsorted(p[:, t], p[i, t] + spill, "right") - np.searchsorted(p[:, t], p[i, t] - spill), abs(i - len(rows) // 2), t, i) for t in range(tries) for i in at]
            zone, _, t, i = min(worth)
            if zone * 3 < len(rows):
                dirs[me], cuts[me] = d[t], float(p[i, t])
                own = sample[rows] @ d[t]
                left[me] = node(rows[own <= cuts[me] + spill])
                right[me] = node(rows[own > cuts[me] - spill])
                return me
        left[me] = -1 - leaves
        leaves += 1
        return me

    node(np.arange(len(sample)))
    return Tree(np.array(dirs, np.float32), np.array(cuts), np.array(left), np.array(right))


def leaves_of(tree: Tree, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a vector reaches."""
    out_r, out_l, todo = [], [], [(0, np.arange(len(vectors)))]
    while todo:
        me, rows = todo.pop()
        if tree.left[me] < 0:
            out_r.append(rows)
            out_l.append(np.full(len(rows), -1 - tree.left[me]))
            continue
        own = vectors[rows] @ tree.directions[me]
        for child, side in ((tree.left[me], own <= tree.thresholds[me] + spill), (tree.right[me], own > tree.thresholds[me] - spill)):
            if side.any():
                todo.append((child, rows[side]))
    return np.concatenate(out_r), np.concatenate(out_l)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value that sorted lists share, for rows of two padded tables (pad -1)."""
    hit = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    first = hit.any(axis=2)
    return np.where(first, a, np.iinfo(a.dtype).max).min(axis=1)


def compare(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, members: np.ndarray, side: np.ndarray | None, leaf: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row that no earlier leaf counts, root of each row) within a leaf.

    ``side``: None compares all rows with each other, else those of side 0 with those of
    side 1.  A pair belongs to the first leaf, by number, that its rows share.
    """
    n = len(ids)
    x = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rows = np.arange(n) if side is None else np.flatnonzero(side == 0)
    cols = np.arange(n) if side is None else np.flatnonzero(side == 1)
    for a in range(0, len(rows), 512):
        r = rows[a : a + 512]
        near = x[r] @ x[cols].T >= limit
        if side is None:
            near &= cols[None, :] > r[:, None]
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            i = int(r[k])
            js = cols[near[k]]
            mine = _first_common(np.repeat(members[i : i + 1], len(js), axis=0), members[js]) == leaf
            links[i] += weights[js[mine]].sum()
            links[js[mine]] += weights[i]
            for j in np.unique(root[js]).tolist():
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
    return links, np.array([find(i) for i in range(n)], np.int64)


def link_near(df: DataFrame, id_col: str, vec_col: str, limit: float = 0.95, trees: int = 10, leaf_rows: int = 256, spill: float = 0.01, sample_rows: tuple[int, int] = (16_384, 262_144), task_rows: int = 4096, seed: int = 11) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing;
    so do vectors of different lengths.  Rows with a null id take no part.  Vectors that
    are equal stand for each other and are linked without being compared; a repeated id
    is a row of its own.  The trees are grown on a sample, taken by a hash of the id: one vector in
    64, ``sample_rows`` of them at least (or all) and at most; every vector is put through them.  A leaf larger than ``task_rows`` is compared
    block by block, all of it.  An empty table gives no rows.
    """
    spark = df.sparkSession
    fit = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec_col, lambda x: x != F.lit(0.0))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.when(fit, F.col(vec_col)).alias("v"))
    classes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    d = F.size("v")
    # lengths whose trees would have a root only are compared whole; the others are at most one per leaf_rows rows
    lengths = classes.groupBy(d.alias("d")).count().agg(F.sort_array(F.collect_list(F.when(F.col("count") > leaf_rows, F.col("d")))).alias("many"), F.count(F.lit(1)).alias("n")).first()
    parts = [_links(classes.where(d == k), limit, trees, leaf_rows, spill, sample_rows, task_rows, seed) for k in lengths["many"]]
    if lengths["n"] > len(parts):
        zero = F.lit(0)
        few = classes.where(~d.isin(lengths["many"])).select(zero.alias("leaf"), zero.alias("i"), zero.alias("j"), zero.alias("b"), "rep", "w", "v", F.array(zero).alias("leaves"), d.alias("d"))
        parts.append(few.groupBy("d").applyInArrow(_leaf(limit), "id bigint, root bigint, n bigint"))
    found = parts[0] if parts else spark.createDataFrame([], "id bigint, root bigint, n bigint")
    for p in parts[1:]:
        found = found.unionByName(p)
    found = written(found, "links")
    comp = connected_components(found.where("root <> id").select(F.col("id").alias("u"), F.col("root").alias("v")))
    n_of = found.groupBy("id").agg(F.sum("n").alias("n"))
    ends = comp.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("c"))
    comp = comp.join(ends, "component").select("node", "c")
    per_class = (
        classes.join(n_of.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    )
    out = rows.join(per_class, F.col("v") == F.col("_v"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "id").alias("component_id"), (F.coalesce("c", "id") == F.col("id")).alias("kept"))


def _padded(lists: pa.ListArray) -> np.ndarray:
    """A table of the lists' numbers, -1 where a list is shorter."""
    n = np.asarray(lists.value_lengths(), np.int64)
    out = np.full((len(n), int(n.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.asarray(lists.flatten())
    return out


def _leaf(limit: float) -> Callable[[pa.Table], pa.Table]:
    def leaf(table: pa.Table) -> pa.Table:
        n = table.num_rows
        links, root = np.zeros(n, np.int64), np.arange(n)
        ids = table.column("rep").to_numpy()
        if n > 1:
            v = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(n, -1)
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            side = None if i == j else (table.column("b").to_numpy() == j).astype(int)
            links, root = compare(ids, v, table.column("w").to_numpy(), _padded(table.column("leaves").combine_chunks()), side, table.column("leaf")[0].as_py(), limit)
        linked = (links > 0) | (root != np.arange(n)) | np.isin(np.arange(n), root[root != np.arange(n)])
        return pa.table({"id": ids[linked], "root": ids[root[linked]], "n": links[linked]})

    return leaf


def _links(classes: DataFrame, limit: float, trees: int, leaf_rows: int, spill: float, sample_rows: tuple[int, int], task_rows: int, seed: int) -> DataFrame:
    """(id, root, n) of each leaf's rows with links: a root that they reach, links that the leaf counts."""
    spark = classes.sparkSession
    n = classes.count()
    size = min(max(sample_rows[0], n // 64), sample_rows[1])
    sample = classes.select("v", "least", F.xxhash64("least").alias("h")).orderBy("h", "least", "v").limit(size).select("v").toArrow().column(0).combine_chunks()  # bounded
    s = np.asarray(sample.flatten(), dtype=np.float64).reshape(len(sample), -1)
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    forest = []
    for t in range(trees):
        forest.append(grow(s, len(s) / n, leaf_rows, spill, np.random.default_rng([seed, t])))
    first = np.append(0, np.cumsum([int((t.left < 0).sum()) for t in forest]))
    shared = spark.sparkContext.broadcast((forest, first))  # bounded by the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, first = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(0).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            got = [leaves_of(t, v, spill) for t in forest]
            r, leaf = np.concatenate([g[0] for g in got]), np.concatenate([g[1] + o for g, o in zip(got, first)])
            order = np.lexsort((leaf, r))
            r, leaf = r[order], leaf[order]
            ends = np.searchsorted(r, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf.astype(np.int32)))], names=["v", "rep", "w", "leaves"])

    routed = written(classes.select("v", "rep", "w").mapInArrow(route, T.StructType([*classes.select("v", "rep", "w").schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))])), "routed")
    # one number per leaf: bounded by trees x sample
    sizes = {r["leaf"]: r["count"] for r in routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(f"count > {task_rows}").collect()}
    large = spark.createDataFrame([(k, -(-c // task_rows)) for k, c in sizes.items()], "leaf int, blocks int")
    rows = routed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(large), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))

    return rows.select("leaf", "i", "j", "b", "rep", "w", "v", "leaves").groupBy("leaf", "i", "j").applyInArrow(_leaf(limit), "id bigint, root bigint, n bigint")
