"""Operator 5: exact top-k by inner product with M-trees.

Vectors are turned to integers and dealt to shards.  Within a shard a vector x becomes
(x, sqrt(M^2 - |x|^2)), M the shard's largest norm, and a query (q, 0); the Euclidean
distance between them falls as the inner product rises, so the nearest objects of a
metric tree are the best by score.  Pages hold routing objects with covering radii and
the distances to their parents; a search visits pages best first, and an entry's distance
is computed only if |d(q, parent) - d(entry, parent)| - radius leaves it a chance.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import meet


class MTree:
    """Bulk-loaded tree over the rows of ``vectors`` (integers), found again by ``ids``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 128, seed: int = 3):
        self.ids, self.vectors, self.page = ids, vectors, page
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.square = float(squares.max()) if len(ids) else 0.0
        self.points = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(self.square - squares, 0))])
        #: a page: (is leaf, rows of its objects, distances to the parent, radii, children)
        self.pages: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._rng = np.random.default_rng(seed)
        self.computed = 0
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else -1

    def _from(self, row: int | None, rows: np.ndarray) -> np.ndarray:
        if row is None:
            return np.zeros(len(rows))
        return np.sqrt(((self.points[rows] - self.points[row]) ** 2).sum(axis=1))

    def _spread(self, rows: np.ndarray, many: int) -> np.ndarray:
        """Routing objects: of a sample, one after the other the farthest from those taken."""
        some = self._rng.choice(rows, min(len(rows), 4 * many), replace=False)
        far = self._from(int(some[0]), some)
        out = [int(some[0])]
        while len(out) < many:
            k = int(far.argmax())
            if far[k] <= 0:  # all others are equal to one of them
                break
            out.append(int(some[k]))
            far = np.minimum(far, self._from(int(some[k]), some))
        return np.array(out)

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        if len(rows) <= self.page:
            self.pages.append((True, rows, self._from(parent, rows), np.zeros(len(rows)), np.zeros(0, int)))
            return len(self.pages) - 1
        fan = int(min(self.page, max(2, -(-len(rows) // (self.page // 2)))))
        routing = self._spread(rows, fan)
        p = self.points[routing]
        near = ((p**2).sum(axis=1)[None, :] - 2 * self.points[rows] @ p.T).argmin(axis=1)
        groups = [rows[near == i] for i in range(len(routing))]
        if max(map(len, groups)) == len(rows):  # all alike: any even cut will do
            groups = np.array_split(rows, fan)
            routing = np.array([g[0] for g in groups])
        kept = [(r, g) for r, g in zip(routing.tolist(), groups) if len(g)]
        children = [self._load(g, r) for r, g in kept]
        routing = np.array([r for r, _ in kept])
        radii = np.array([self._from(r, g).max() for r, g in kept])
        self.pages.append((False, routing, self._from(parent, routing), radii, np.array(children)))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) among objects other than ``own``; ties to smaller ids."""
        _, ids, scores = self.search_block(query[None, :], k, np.array([-1 if own is None else own]), own is not None)
        return list(zip(scores.tolist(), ids.tolist()))

    def search_block(self, queries: np.ndarray, k: int, own: np.ndarray, leave_out: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score): the k best of each query among objects with other ids than its own.

        The queries go through the tree together: the page with the least bound of any of them is next,
        and only those take part in it whose bounds allow a better result there.
        """
        n = len(queries)
        none = np.zeros(0, np.int64)
        if self.root < 0 or not n:
            return none, none, none
        # products of doubles are whole numbers as long as these are below 2^53
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
        kind = np.float64 if exact else np.int64
        q, low_score = queries.astype(kind), np.float64(-np.inf) if exact else np.int64(-(2**63) + 1)
        points = np.column_stack([queries.astype(np.float64), np.zeros(n)])
        squares = (points**2).sum(axis=1)
        slack = 1e-6 * (1.0 + np.sqrt(self.square) + np.sqrt(squares))  # rounding only
        score, ident = np.full((n, k), low_score, kind), np.full((n, k), np.iinfo(np.int64).max)
        have, reach = np.zeros(n, np.int64), np.full(n, np.inf)
        every = np.arange(n)
        todo = [(0.0, 0, self.root, every, np.zeros(n), None)]
        count = 1
        while todo:
            least, _, page, act, bound, dq = heapq.heappop(todo)
            if least > reach.max():
                break
            some = bound <= reach[act]
            act = act[some]
            if not len(act):
                continue
            leaf, rows, to_parent, radii, children = self.pages[page]
            may = np.ones((len(act), len(rows)), bool)
            if dq is not None:
                may = np.abs(dq[some][:, None] - to_parent) - radii <= reach[act][:, None]
                used = may.any(axis=0)
                rows, radii, may = rows[used], radii[used], may[:, used]
                children = children if leaf else children[used]
                if not len(rows):
                    continue
            self.computed += int(may.sum())
            if leaf:
                got = np.where(may, q[act] @ self.vectors[rows].astype(kind).T, low_score)
                mine = self.ids[rows]
                if leave_out:
                    may &= mine != own[act][:, None]
                    got[~may] = low_score
                # ties with the last of the best may still win by their ids
                at = np.flatnonzero((may & (got >= score[act, -1:])).any(axis=1))
                if not len(at):
                    continue
                a = act[at]
                both = np.concatenate([score[a], got[at]], axis=1)
                names = np.concatenate([ident[a], np.where(may[at], mine, np.iinfo(np.int64).max)], axis=1)
                order = np.argsort(names, axis=1, kind="stable")
                best = np.take_along_axis(order, np.argsort(-np.take_along_axis(both, order, 1), axis=1, kind="stable")[:, :k], 1)
                score[a], ident[a] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                have[a] = np.minimum(k, have[a] + may[at].sum(axis=1))
                full = a[have[a] == k]
                reach[full] = np.sqrt(np.maximum(squares[full] + self.square - 2.0 * score[full, -1].astype(np.float64), 0.0)) + slack[full]
            else:
                p = self.points[rows]
                d = np.sqrt(np.maximum(squares[act][:, None] + (p**2).sum(axis=1) - 2.0 * points[act] @ p.T, 0.0))
                low = np.maximum(d - radii - slack[act][:, None], 0.0)
                fits = may & (low <= reach[act][:, None])
                for j in np.flatnonzero(fits.any(axis=0)).tolist():
                    f = fits[:, j]
                    heapq.heappush(todo, (float(low[f, j].min()), count, int(children[j]), act[f], low[f, j], d[f, j]))
                    count += 1
        there = np.arange(k)[None, :] < have[:, None]
        return np.repeat(every, have), ident[there], score[there].astype(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, dim, v): floor(scale * x) of every vector without null or non-finite components."""
    fit = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), F.size(vec_col).alias("dim"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint")).alias("v")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` (both: id, dim, v) other than itself.

    Returns query_id, rank (from 1), vec_id, score: the integer inner product, ties to the
    smaller id; all rows if there are fewer.  A vector is compared with queries of its own
    length only.  Repeated rows are objects of their own; a query's own id is never its
    result.  Other columns are ignored; empty tables give no rows.

    A tree of about ``shard_rows`` objects stays in its task, and the queries pass by in blocks of
    about ``block_rows``, so a task's memory is bounded at any size.
    """

    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))

    def dealt(df: DataFrame, many: int, name: str) -> DataFrame:
        return df.select("dim", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias(name), "id", "v").groupBy("dim", name)

    def packed(name: str, build: Callable[[np.ndarray, np.ndarray], object]) -> Callable[[pa.Table], pa.Table]:
        def pack(table: pa.Table) -> pa.Table:
            lists = table.column("v").combine_chunks()
            x = np.asarray(lists.flatten()).reshape(len(lists), -1)
            payload = pickle.dumps(build(table.column("id").to_numpy(), x))
            return pa.table({"dim": table.column("dim").slice(0, 1), name: table.column(name).slice(0, 1), "payload": pa.array([payload], pa.binary())})

        return pack

    def find(tree: MTree, asked: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        row, ids, scores = tree.search_block(asked[1], k, asked[0])
        return pa.RecordBatch.from_arrays([pa.array(asked[0][row]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    trees = dealt(vectors, shards, "shard").applyInArrow(packed("shard", MTree), "dim int, shard int, payload binary")
    asks = dealt(queries, blocks, "block").applyInArrow(packed("block", lambda *x: x), "dim int, block int, payload binary")
    asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "payload")
    found = meet(trees, asks, ["dim", "shard"], shards, find, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
