"""Operator 6: exact Jaccard join of shingle sets, as a metric-space join.

Jaccard distance (1 - similarity) is a metric.  A group of sets is joined by pivots: each
set goes to the Voronoi region of its nearest pivot, and also to every region whose pivot is
at most 2r farther than that, r being the largest distance of a link; by the triangle
inequality every linked pair meets in a region, and regions are joined in the same way until
they are small, over the cluster first and then within a task.  Only components are wanted, so pairs already connected aren't compared.

Sets of unrelated texts are nearly all at distance 1 from any pivot, so pivots alone would
put the whole corpus into every region.  The groups therefore come from a filter that loses
no pair: with its members ordered from rare to frequent, a set shares with each set it is
linked to one of its first ones, as many as the sets may differ by and one more.  Members that
no other set has are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import connected_components
from .shared import input_bytes, lean, one_row_per_id, tidy, written

U64 = np.uint64
_SKETCH = 8  # 64-bit words
_ALL_PAIRS = 8


@dataclass(frozen=True)
class Likeness:
    """Two sets link when ``den`` * intersection >= ``num`` * union."""

    num: int
    den: int

    @property
    def radius(self) -> float:
        return 1.0 - self.num / self.den

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (common > 0) & (self.den * common >= self.num * (a + b - common))

    def differences(self, total: int) -> int:
        """Most differences of linked sets with ``total`` members together."""
        return total * (self.den - self.num) // (self.den + self.num)


@dataclass
class Sets:
    """Shingle sets of a slice's rows: members of row i are values[first[i]:first[i+1]], sorted."""

    values: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray, k: int, key: int) -> Sets:
        got = textops.shingle_sets(textops.Words(data, offs, lower=True), k, key)
        return cls(np.concatenate([*got, np.zeros(0, U64)]), np.append(0, np.cumsum([len(g) for g in got])).astype(np.int64))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, salt: int) -> np.ndarray:
        """Sum modulo 2^64 of each set's members, mixed with ``salt``."""
        total = np.append(U64(0), np.cumsum(textops.mix(self.values + U64(salt))))
        return total[self.first[1:]] - total[self.first[:-1]]

    def sketches(self) -> np.ndarray:
        """A parity bit for each of 512 classes of members: sketches of sets differ in no more bits than the sets do in members."""
        bits = 64 * _SKETCH
        row = np.repeat(np.arange(len(self.first) - 1), self.sizes)
        odd = np.bincount(row * bits + (textops.mix(self.values ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64), minlength=(len(self.first) - 1) * bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, _SKETCH)


def prefixes(sets: Sets, tiers: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(member, row): the rarest members of each set, one more than it may differ by from a set
    it is linked to, without those of tier 0, which stand alone."""
    n = sets.sizes
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((sets.values, tiers, row))
    keep = n - -(-n * like.num // like.den) + 1
    place = np.arange(len(order)) - sets.first[:-1][row]
    at = order[(place < keep[row]) & (tiers[order] > 0)]
    return sets.values[at], row[at]


class Union:
    """Union-find over 0..n-1; a root is its component's smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


class Region:
    """Sets in one task, joined by pivots."""

    LEAF, PIVOTS = 48, 8

    def __init__(self, sets: list[np.ndarray], like: Likeness, side: np.ndarray | None = None):
        self.like, self.side = like, side
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.first = np.append(0, np.cumsum(self.sizes))
        _, self.tokens = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True)
        self.union = Union(len(sets))
        self.compared = 0

    def _members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        own = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rows], n)
        return own, self.tokens[at]

    def common(self, pivot: int, own: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
        """Members that each of n rows (``own``, ``tokens``) shares with the pivot."""
        self.compared += n
        has = self._flag
        mine = self.tokens[self.first[pivot] : self.first[pivot + 1]]
        has[mine] = True
        out = np.bincount(own, has[tokens], n).astype(np.int64)
        has[mine] = False
        return out

    def run(self, inner: np.ndarray | None = None) -> np.ndarray:
        """Component root of each row, by the links that ``inner`` rows (all if not given) have."""
        self._flag = np.zeros(int(self.tokens.max(initial=-1)) + 1, bool)
        rows = np.flatnonzero(self.sizes)
        self._join(rows, np.ones(len(rows), bool) if inner is None else inner[rows], np.random.default_rng(len(rows)))
        return self.union.roots()

    def _link(self, pivot: int, rows: np.ndarray, common: np.ndarray) -> np.ndarray:
        size = self.sizes[pivot]
        ok = self.like.linked(common, np.full(len(rows), size), self.sizes[rows])
        if self.side is not None:
            ok &= self.side[rows] != self.side[pivot]
        self.union.join(pivot, rows[ok & (rows != pivot)])
        return 1.0 - common / np.maximum(size + self.sizes[rows] - common, 1)

    def _join(self, rows: np.ndarray, inner: np.ndarray, rng: np.random.Generator) -> None:
        """Find links between ``inner`` rows and all ``rows``."""
        roots = self.union.roots()[rows]
        if not inner.any() or (roots == roots[0]).all():
            return
        own, tokens = self._members(rows)
        if len(rows) > self.LEAF:
            pick = rng.choice(len(rows), self.PIVOTS, replace=False)
            d = np.stack([self._link(int(rows[p]), rows, self.common(int(rows[p]), own, tokens, len(rows))) for p in pick])
            near = d.argmin(axis=0)
            reach = d.min(axis=0) + 2 * self.like.radius + 1e-9
            groups = [(inner & (near == i), (near == i) | (d[i] <= reach)) for i in range(len(pick))]
            if max(int(g.sum()) for _, g in groups) <= 0.75 * len(rows):
                for mine, there in groups:
                    if mine.any():
                        self._join(rows[there], mine[there], rng)
                return
        # a leaf, or sets that pivots can't part: each inner row with those it isn't connected to
        up = self.union
        at = {int(r): i for i, r in enumerate(rows)}
        low = self.sizes[rows] * self.like.num
        for x in rows[inner].tolist():
            roots = up.roots()[rows]
            mine = roots[at[x]]
            size = int(self.sizes[x])
            todo = (roots != mine) & (low <= size * self.like.den) & (self.sizes[rows] * self.like.den >= size * self.like.num)
            if self.side is not None:
                todo &= self.side[rows] != self.side[x]
            if todo.any():
                if todo.mean() < 0.5:
                    some = np.flatnonzero(todo)
                    o, t = self._members(rows[some])
                    self._link(x, rows[some], self.common(x, o, t, len(some)))
                else:
                    self._link(x, rows, self.common(x, own, tokens, len(rows)))


def set_facts(docs: DataFrame, k: int, key: int) -> DataFrame:
    """doc_id, n (set size), f0 and f1 (fingerprint of the set), s0.. (parity sketch)."""
    names = ["doc_id", "n", "f0", "f1", *[f"s{i}" for i in range(_SKETCH)]]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs):
                sets = Sets.of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k, key)
                cols = [pa.array(sets.sizes), *[pa.array(sets.sums(s).view(np.int64)) for s in (1, 2)], *[pa.array(np.ascontiguousarray(c)) for c in sets.sketches().T]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names=names)

    return docs.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _distinct(sets: Sets, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row is the smallest id of its set in the slice, (that id, id) of the others)."""
    one, two = sets.sums(1), sets.sums(2)
    order = np.lexsort((ids, one, two, sets.sizes))
    s1, s2, n = one[order], two[order], sets.sizes[order]
    new = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (n[1:] != n[:-1]))[: len(order)]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    copies = np.flatnonzero(~new & (n > 0))
    first = np.zeros(len(ids), bool)
    first[order[new]] = True
    return first, np.stack([ids[head[copies]], ids[order[copies]]], axis=1).astype(np.int64)


def _stretches(key: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(key, begin, end) of each stretch of a sorted array."""
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(key)).tolist() if len(cuts) else []


def frequencies(docs: DataFrame, k: int, key: int, buckets: int, entries: int) -> dict[int, bytes]:
    """For each bucket a table of ``entries`` bytes: the largest floor(log2(sets that have it))
    among the members of an entry, so 0 means that no member of it is in two sets.

    Every set is counted (equal ones of a slice once); a member travels as 32 bits of its hash.
    """

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs):
                sets = Sets.of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k, key)
                first, _ = _distinct(sets, ids[i:j])
                values, n = np.unique(sets.values[np.repeat(first, sets.sizes)], return_counts=True)
                h = textops.mix(values ^ U64(0x6A09E667F3BCC909))
                bucket = (h % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                n = np.minimum(n[order], 0xFFFF).astype(np.uint16)
                of, begin, end = _stretches(bucket[order])
                short = ((h[order] >> U64(24)) & U64(0xFFFFFFFF)).astype(np.uint32)
                rows = [[], []]
                for x, y in zip(begin, end):
                    some = n[x:y] > 1
                    rows[0].append(short[x:y][~some].tobytes())
                    rows[1].append(short[x:y][some].tobytes() + n[x:y][some].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["bucket", "once", "more"])

    def fill(table: pa.Table) -> pa.Table:
        once = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("once").to_pylist()])
        more = [(np.frombuffer(x, np.uint32, len(x) // 6), np.frombuffer(x, np.uint16, len(x) // 6, len(x) // 6 * 4)) for x in table.column("more").to_pylist()]
        values = np.concatenate([once, *[v for v, _ in more]])
        counts = np.concatenate([np.ones(len(once), np.int64), *[n.astype(np.int64) for _, n in more]])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.add.reduceat(counts, first)
        tier = np.log2(total).astype(np.uint8)
        out = np.zeros(entries, np.uint8)
        some = tier > 0
        np.maximum.at(out, values[first][some].astype(np.int64) % entries, tier[some])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "tiers": pa.array([out.tobytes()], pa.binary())})

    sent = docs.mapInArrow(send, "bucket int, once binary, more binary")
    rows = sent.groupBy("bucket").applyInArrow(fill, "bucket int, tiers binary").toArrow()
    return dict(zip(rows.column("bucket").to_pylist(), rows.column("tiers").to_pylist()))


def candidates(docs: DataFrame, k: int, key: int, like: Likeness, count_bytes: int = 4 << 20, meet_bytes: int = 32 << 20, table_bytes: int = 64 << 20) -> DataFrame:
    """(a, b, group): rows that share a rare member; ``group``: one of many, tied to the smallest id only.

    The table of frequencies has ``table_bytes`` bytes at most; if it is too small for a corpus,
    more members travel, and no pair is lost.
    """
    spark = docs.sparkSession
    size = input_bytes(docs, "text")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // count_bytes))
    # few members travel, and a pair is found once in each bucket that holds some it shares
    meetings = max(1, -(-size // meet_bytes))
    entries = max(1 << 10, min(table_bytes, size // 16) // buckets)
    shared = spark.sparkContext.broadcast(frequencies(docs, k, key, buckets, entries))

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((buckets, entries), np.uint8)
        for bucket, x in shared.value.items():
            table[bucket] = np.frombuffer(x, np.uint8)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs):
                sets = Sets.of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k, key)
                own = ids[i:j]
                first, same = _distinct(sets, own)
                # bucket and entry as in frequencies(), where 32 bits of the hash remain
                h = textops.mix(sets.values ^ U64(0x6A09E667F3BCC909))
                tiers = table[(h % U64(buckets)).astype(np.int64), ((h >> U64(24)) & U64(0xFFFFFFFF)).astype(np.int64) % entries]
                member, row = prefixes(sets, tiers, like)
                member, row = member[first[row]], row[first[row]]
                bucket = ((member >> U64(40)) % U64(meetings)).astype(np.int32)
                o = np.argsort(bucket, kind="stable")
                member, doc = member[o], own[row[o]]
                of, begin, end = _stretches(bucket[o])
                rows = [of, [member[x:y].tobytes() for x, y in zip(begin, end)], [doc[x:y].tobytes() for x, y in zip(begin, end)], [b""] * len(of)]
                if len(same):
                    for column, v in zip(rows, (int(own[0]) % meetings, b"", b"", same.tobytes())):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["bucket", "sig", "doc", "same"])

    def meet(table: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(x, U64) for x in table.column("sig").to_pylist()])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist()])
        same = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("same").to_pylist()]).reshape(-1, 2)
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        new = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(sig)))
        pairs = []
        for m in range(2, _ALL_PAIRS + 1):
            at = first[size == m]
            for x in range(m):
                for y in range(x + 1, m):
                    pairs.append(np.stack([doc[at + x], doc[at + y]], axis=1))
        small = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
        big = np.flatnonzero(size > _ALL_PAIRS)
        group = np.repeat(np.arange(len(big)), size[big])
        at = np.arange(len(group)) - np.repeat(np.cumsum(size[big]) - size[big], size[big]) + np.repeat(first[big], size[big])
        least = np.minimum.reduceat(doc[at], np.cumsum(size[big]) - size[big]) if len(big) else np.zeros(0, np.int64)
        large = np.concatenate([np.stack([least[group], doc[at]], axis=1), same])
        out = []
        for p, kind in ((small, False), (large, True)):
            p = np.sort(p[p[:, 0] != p[:, 1]], axis=1)
            p = np.unique(p, axis=0) if len(p) else p
            out.append(pa.table({"a": pa.array(np.ascontiguousarray(p[:, 0])), "b": pa.array(np.ascontiguousarray(p[:, 1])), "group": pa.array(np.full(len(p), kind))}))
        return pa.concat_tables(out)

    sent = docs.mapInArrow(send, "bucket int, sig binary, doc binary, same binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, group boolean").groupBy("a", "b").agg(F.bool_or("group").alias("group"))


def _measured(rows: DataFrame, members: DataFrame, words: int, key: int, like: Likeness, pivots: int, turn: int = 0) -> DataFrame:
    """(region, rep, d, linked): each set's distances to a few pivots of its region, and those it is linked with.

    ``members``: region, rep.
    """
    picks = members.groupBy("region").agg(*[F.min_by("rep", F.xxhash64("rep", F.lit(turn * pivots + i))).alias(f"p{i}") for i in range(pivots)])
    picks = picks.select("region", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))).alias("rep"))
    given = rows.join(picks.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rep", "text"))).alias("pivots"))  # a few
    met = rows.join(members.select("region", "rep").hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).join(given.hint("merge"), "region").select("region", "rep", "text", "pivots")

    def sets_of(texts: list[str | None]) -> list[np.ndarray]:
        data, offs = textops.text_buffer(pa.array(texts, pa.string()))
        return textops.shingle_sets(textops.Words(data, offs, lower=True), words, key)

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centers, ids = None, [], []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                distances, linked = [], []
                for region, rep, own, given in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets_of(part.column(2).to_pylist()), part.column(3)):
                    if region != last:
                        last, found = region, given.as_py()
                        ids, centers = [g["rep"] for g in found], sets_of([g["text"] for g in found])
                    common = np.array([len(np.intersect1d(own, c, assume_unique=True)) for c in centers])
                    sizes = np.array([len(c) for c in centers])
                    distances.append((1.0 - common / np.maximum(len(own) + sizes - common, 1)).tolist())
                    linked.append([p for p, ok in zip(ids, like.linked(common, len(own), sizes).tolist()) if ok and p != rep])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(distances, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.int64()))], names=["region", "rep", "d", "linked"])

    return written(met.mapInArrow(measure, "region bigint, rep bigint, d array<double>, linked array<bigint>"), "distances")


def _by_pivots(rows: DataFrame, members: DataFrame, words: int, key: int, like: Likeness, pivots: int = 8) -> tuple[DataFrame, DataFrame]:
    """(sets still to be joined, links to pivots) of regions too large for a task.

    ``members``: region, rep, n.  Every set meets a few pivots of its region; those linked with
    them, directly or through each other, are one component.  What is left to join are the sets
    outside a region's largest component, and of that the ones that the triangle inequality leaves
    within a link's distance of them, by the distances to all pivots.
    """
    dist = _measured(rows, members, words, key, like, pivots)
    tied = dist.select(F.col("rep").alias("u"), F.explode("linked").alias("v"))
    comp = connected_components(tied)
    label = dist.join(comp, F.col("rep") == F.col("node"), "left").select("region", "rep", "d", F.coalesce("component", "rep").alias("c"))
    label = written(label, "labels")
    main = label.groupBy("region", "c").count().groupBy("region").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    apart = label.join(main, "region").where("c <> main")
    reach = like.radius + 1e-9
    range_of = apart.groupBy("region").agg(*[f(F.get("d", F.lit(i))).alias(f"{n}{i}") for i in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for i in range(pivots):
        d = F.get("d", F.lit(i))
        inside = inside & (d.isNull() | ((d >= F.col(f"lo{i}") - reach) & (d <= F.col(f"hi{i}") + reach)))
    near = label.join(range_of, "region").where(inside).select("region", "rep")
    return near.join(members.select("rep", "n"), "rep").select("region", "rep", "n"), tied


def _by_size(members: DataFrame, like: Likeness) -> DataFrame:
    """``members`` (region, rep, n, inner) dealt to classes of sizes so wide that linked sets are in one
    or in two that adjoin; a set is also, not as an inner one, in the class above its own."""
    width = -np.log(like.num / like.den) * (1 + 1e-9) + 1e-12
    own = F.floor(F.log("n") / width)
    there = F.explode(F.array(F.struct(own.alias("c"), F.col("inner")), F.struct((own + 1).alias("c"), F.lit(False).alias("inner")))).alias("x")
    dealt = members.select("region", "rep", "n", there).select(F.xxhash64("region", "x.c").alias("region"), "rep", "n", "x.inner")
    return dealt.join(dealt.where("inner").select("region").distinct(), "region", "left_semi")


def _by_regions(rows: DataFrame, members: DataFrame, words: int, key: int, like: Likeness, most: int, turns: int = 6, pivots: int = 8) -> DataFrame:
    """(region, rep, n, inner): regions of ``members`` (region, rep, n) cut until a task can hold them.

    Regions of over ``most`` members of sets are cut by the sets' sizes, then turn by turn by pivots.  A set is
    an inner one of its nearest pivot's region if that is at most 1 - 2r away, else of the region of what is far from all.
    It stands also in each region that may hold an inner set it is linked with: where the
    pivot is at most 2r farther than its nearest and 1 - r away, and, if its nearest is over 1 - 3r
    away, in the far one.  So each link has an inner set in a region that holds both.  A region
    stays whole where that saves too few comparisons for the sets it copies.
    """
    state = written(members.withColumn("inner", F.lit(True)).withColumn("whole", F.lit(False)), "regions")
    r, slack = like.radius, 1e-9
    for turn in range(turns + 1):
        each = state.where("NOT whole").groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"), F.count_if("inner").alias("inners"))
        large = written(each.where(F.col("total") > most).drop("total"), "large")
        if not large.limit(1).count():
            break
        some = state.join(large, "region", "left_semi").drop("whole")
        if turn == 0:
            state = written(state.join(large, "region", "left_anti").unionByName(_by_size(some, like).withColumn("whole", F.lit(False))), "regions")
            continue
        dist = _measured(rows, some, words, key, like, pivots, turn).select("region", "rep", "d", F.array_min("d").alias("least")).join(some, ["region", "rep"])
        far = F.col("least") > 1 - 2 * r
        reach = F.least(F.col("least") + 2 * r, F.lit(1 - r)) + slack
        near = F.transform("d", lambda x, i: F.struct(i.alias("at"), (F.col("inner") & ~far & (i + 1 == F.array_position("d", F.col("least")))).alias("inner"), (x <= reach).alias("there")))
        apart = F.array(F.struct(F.lit(-1).alias("at"), (F.col("inner") & far).alias("inner"), (F.col("least") > 1 - 3 * r - slack).alias("there")))
        parts = dist.select("region", "rep", "n", F.explode(F.filter(F.concat(near, apart), lambda x: x["there"])).alias("x"))
        parts = parts.select("region", F.xxhash64("region", "x.at", F.lit(turn)).alias("part"), "rep", "n", "x.inner")
        parts = written(parts, "parts")
        of_part = parts.groupBy("region", "part").agg(F.count(F.lit(1)).alias("s"), F.count_if("inner").alias("i")).where("i > 0")
        cut = of_part.groupBy("region").agg(F.sum("s").alias("s"), F.sum(F.col("s").cast("double") * F.col("i")).alias("work")).join(large, "region")
        copies, work = F.col("s") / F.col("sets"), F.col("work") / F.col("sets") / F.col("inners")
        cut = written(cut.where((copies * work <= 0.9) & (copies <= 1.5)).select("region"), "cut")
        new = parts.join(cut, "region", "left_semi").join(of_part.select("part"), "part", "left_semi").select(F.col("part").alias("region"), "rep", "n", "inner")
        old = state.join(cut, "region", "left_anti").join(large.select("region", F.lit(True).alias("stuck")), "region", "left")
        old = old.select("region", "rep", "n", "inner", (F.col("whole") | F.col("stuck").isNotNull()).alias("whole"))
        state = written(old.unionByName(new.withColumn("whole", F.lit(False))), "regions")
    return state.drop("whole")


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, region_members: int = 1 << 20) -> DataFrame:
    """One row per document of ``docs`` (``doc_id``, ``text``): n_shingles, component_id.

    The set of a text is its distinct ``words``-word shingles, A-Z lower-cased; a shorter text
    has its whole sequence as one, a text that is null or without words has none and links with
    nothing.  Two texts link when den * intersection >= num * union; ``component_id`` is
    the smallest ``doc_id`` reachable by links.  Equal sets are compared once.  Rows with a null
    ``doc_id`` take no part, and of rows that share one the first stands (see
    one_row_per_id).  Other columns are ignored.  An empty table gives no rows.
    """
    like, key = Likeness(num, den), textops.fresh_key()
    rows = one_row_per_id(docs, "doc_id", ["text"]).select(F.col("doc_id").cast("bigint"), "text")
    facts = written(set_facts(rows, words, key), "facts")
    found = written(candidates(rows, words, key, like), "candidates")
    # pairs whose sizes or sketches differ too much for a link go
    names = ["n", *[f"s{i}" for i in range(_SKETCH)]]
    a = facts.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = facts.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(_SKETCH)), F.lit(0))
    near = (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num) & (apart * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    pairs = found.where("NOT group").join(a, "a").join(b, "b").where(near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = pairs.union(found.where("group").select(F.col("a").alias("u"), F.col("b").alias("v")))
    regions = connected_components(edges)
    members = facts.join(regions, facts["doc_id"] == regions["node"]).select("doc_id", "n", "f0", "f1", F.col("component").alias("region"))
    reps = members.groupBy("region", "n", "f0", "f1").agg(F.min("doc_id").alias("rep"))
    size = reps.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    large = size.where(F.col("total") > region_members).select("region")
    joined, tied = reps.join(size.where(F.col("total") <= region_members), "region", "left_semi").select("region", "rep", "n", F.lit(True).alias("inner")), None
    if large.limit(1).count():
        near, tied = _by_pivots(rows, reps.join(large, "region", "left_semi"), words, key, like)
        joined = joined.unionByName(_by_regions(rows, near, words, key, like, region_members))
    # what is still larger than a task should hold is joined block by block, in every pair of blocks
    blocks = joined.groupBy("region").agg(F.ceil(F.sum("n") / region_members).cast("int").alias("blocks"))
    todo = joined.join(blocks, "region").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    todo = todo.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("region", "rep", "inner", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    texts = rows.join(todo.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("region", "i", "j", "own", "rep", "inner", "text")

    def region(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        data, offs = textops.text_buffer(pa.concat_arrays(table.column("text").chunks) if table.num_rows else pa.array([], pa.string()))
        sets = []
        for x, y in textops.slices(offs):
            sets += textops.shingle_sets(textops.Words(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], lower=True), words, key)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = None if i == j else (table.column("own").to_numpy() == j).astype(np.int8)
        root = Region(sets, like, side).run(table.column("inner").to_numpy())
        moved = np.flatnonzero(root != np.arange(len(ids)))
        tidy()
        return pa.table({"u": pa.array(ids[moved]), "v": pa.array(ids[root[moved]])})

    links = written(texts.groupBy("region", "i", "j").applyInArrow(region, "u bigint, v bigint"), "links")
    if tied is not None:
        links = connected_components(links.union(tied)).select(F.col("node").alias("u"), F.col("component").alias("v"))
    of_rep = links.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    classes = reps.join(of_rep, "rep", "left").select("n", "f0", "f1", F.coalesce("root", "rep").alias("component_id"))
    return facts.join(classes, ["n", "f0", "f1"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))
