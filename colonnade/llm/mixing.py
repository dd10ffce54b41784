"""Operator 1: mixing sources to target weights, in blocks of words.

The words of each source, its documents in ``doc_id`` order, are cut into blocks of
fixed length.  The mix is a sequence of slots in output shards.  Each shard draws how
many of its slots fall to each source from the multinomial distribution that the
targets give, conditioned on the sources' totals so that these are met exactly: the
shards are leaves of a binary tree whose nodes split their sources' counts by a
multivariate hypergeometric draw, so a shard finds its counts, and how many slots of
each source stand before it, in log2(shards) draws and without the other shards.
The k-th slot of a source takes block perm(k mod n) of its epoch k div n, where perm is
a Feistel permutation of the n block indexes keyed by seed, source and epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import lean, prefix_sums, written

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Target of each source: its weight's share of the total, no more than ``most`` times its size.

    Sources in code point order, null last, take the weights in turn.  What a cap cuts
    off is shared again by weight among the sources below theirs.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _round_keys(*key: int) -> np.ndarray:
    return textops.mix(np.arange(1, 5, dtype=np.uint64) * textops.U64(0x9E3779B97F4A7C15) + textops.U64(hash(key) % (1 << 63)))


def permuted(index: np.ndarray, n: int, key: tuple[int, int, int], inverse: bool = False) -> np.ndarray:
    """Images (or preimages) of ``index`` under a pseudorandom permutation of 0..n-1.

    A four-round Feistel network over the least even number of bits that holds n - 1;
    values of n or more go through it again until they fall below n.
    """
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    mask, keys = textops.U64((1 << half) - 1), _round_keys(*key)
    if inverse:
        keys = keys[::-1]
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> textops.U64(half), y & mask
        if inverse:
            a, b = b, a
        for k in keys:
            a, b = b, a ^ (textops.mix(b + k) & mask)
        if inverse:
            a, b = b, a
        x[todo] = (a << textops.U64(half)) | b
        todo &= x >= textops.U64(n)
    return x.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """What the mix takes of one source: whole epochs, then ``slots`` of one more.

    The last of these takes only ``last`` words, so that the total is ``words``.
    """

    source: str | None
    size: int
    target: float
    words: int
    blocks: int
    epochs: int
    slots: int
    last: int

    @property
    def total_slots(self) -> int:
        return self.epochs * self.blocks + self.slots


def quota(source: str | None, rank: int, size: int, target: float, block: int, seed: int) -> Quota:
    words, blocks = int(round(target)), -(-size // block)
    if not size:
        return Quota(source, 0, target, 0, 0, 0, 0, 0)
    epochs, rest = divmod(words, size)
    if not rest:
        return Quota(source, size, target, words, blocks, epochs, 0, 0)
    short = size - (blocks - 1) * block
    at = int(permuted(np.array([blocks - 1]), blocks, (seed, rank, epochs), inverse=True)[0])
    # words of the first j slots: j * block, less what the short block lacks once it is among them
    slots = -(-rest // block)
    if slots > at:
        slots = max(at + 1, -(-(rest + block - short) // block))
    before = (slots - 1) * block - (block - short if slots - 1 > at else 0)
    return Quota(source, size, target, words, blocks, epochs, slots, rest - before)


def _split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``counts`` fall among the first ``left`` of their places."""
    out, total = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        if not c or not left:
            continue
        rest = total - c
        if total < 900_000_000:  # the exact draw's range
            k = int(rng.hypergeometric(c, rest, left)) if rest else left
        else:
            mean = left * c / total
            spread = (mean * (1 - c / total) * (total - left) / (total - 1)) ** 0.5
            k = int(round(rng.normal(mean, spread)))
            k = min(max(k, left - rest, 0), c, left)
        out[i], left, total = k, left - k, rest
    return out


def shard_counts(totals: np.ndarray, shards: int, per_shard: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard, slots of each source before it)."""
    lo, hi, counts, before = 0, shards, totals.copy(), np.zeros_like(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(counts, min((mid - lo) * per_shard, int(counts.sum())), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return counts, before


@dataclass
class Mix:
    """``docs``: row_key, doc_id, source, text_hash, size, offset.  ``spans``: the mix itself, one
    row per (slot, document): shard, slot, source, epoch, block, row_key, doc_id, text_hash, start,
    n - words start..start+n-1 of the document."""

    docs: DataFrame
    quotas: list[Quota]
    spans: DataFrame


SLOTS = "shard bigint, slot int, rank int, epoch bigint, block bigint, take bigint"


def mix_sources(docs: DataFrame, block: int = 512, per_shard: int = 1024, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> Mix:
    """Mix every document of ``docs`` (``doc_id``, ``text``, ``source``) to its source's target.

    A null or empty text has no words and is never taken; a null source is a source of its
    own.  Every row is a document, those with a null or a shared ``doc_id`` too; in a source
    they stand by ``doc_id``, nulls first, then by a hash of the text.  Other columns are
    ignored.  An empty table gives an empty mix.  Reruns on the same rows agree.

    The driver and every shard hold a few numbers for each source, which is meant for up to
    some ten thousand of them.
    """
    spark = docs.sparkSession

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = textops.text_buffer(b.column(3))
            n = [textops.Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).counts for i, j in textops.slices(offs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64))], names=["doc_id", "source", "text_hash", "size"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.xxhash64("text").alias("text_hash"), "text")
    # written, since the range partitioner would count the words once for its sample and once more
    counted = written(rows.mapInArrow(count, "doc_id bigint, source string, text_hash bigint, size bigint"), "counted")
    sized = prefix_sums(counted, ["source"], ["doc_id", "text_hash"], "size", "offset", "sized")
    # one row per source
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes, weights, most)
    quotas = [quota(s, i, sizes[s], goal[s], block, seed) for i, s in enumerate(goal_order(goal))]
    totals = np.array([q.total_slots for q in quotas], np.int64)
    shards = max(1, -(-int(totals.sum()) // per_shard))

    @lean
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = shard_counts(totals, shards, per_shard, shard, seed)
                out = [[], [], [], []]
                for rank, (c, k0) in enumerate(zip(counts.tolist(), before.tolist())):
                    if not c:
                        continue
                    q = quotas[rank]
                    k = np.arange(k0, k0 + c)
                    epoch, at, blk = k // q.blocks, k % q.blocks, np.empty(c, np.int64)
                    for e in np.unique(epoch).tolist():
                        blk[epoch == e] = permuted(at[epoch == e], q.blocks, (seed, rank, e))
                    take = np.where(k == q.total_slots - 1, q.last or block, block)
                    for column, v in zip(out, (np.full(c, rank, np.int32), epoch, blk, take)):
                        column.append(v)
                if out[0]:
                    cols = [np.concatenate(c) for c in out]
                    order = np.random.default_rng([seed, shards, shard]).permutation(len(cols[0]))
                    cols = [c[order] for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard, np.int64)), pa.array(np.arange(len(order), dtype=np.int32)), *[pa.array(c) for c in cols]], names=["shard", "slot", "rank", "epoch", "block", "take"])

    slots = spark.range(shards if totals.sum() else 0).mapInArrow(draw, SLOTS)
    names = spark.createDataFrame([(i, q.source) for i, q in enumerate(quotas)], "rank int, source string")
    b = F.lit(block)
    parts = (
        sized.where("size > 0")
        .join(F.broadcast(names.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("block", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))))
        .select("rank", "block", "row_key", "doc_id", "text_hash", "source", "offset", F.greatest(F.col("block") * b, F.col("offset")).alias("a"), F.least((F.col("block") + 1) * b, F.col("offset") + F.col("size")).alias("z"))
    )
    end = F.least(F.col("z"), F.col("block") * b + F.col("take"))
    # the slots' number isn't known to the planner, which would broadcast them
    spans = slots.join(parts.hint("merge"), ["rank", "block"]).where(end > F.col("a")).select("shard", "slot", "source", "epoch", "block", "row_key", "doc_id", "text_hash", (F.col("a") - F.col("offset")).alias("start"), (end - F.col("a")).alias("n"))
    return Mix(sized, quotas, spans)


def goal_order(goal: dict[str | None, float]) -> list[str | None]:
    return sorted(s for s in goal if s is not None) + [s for s in goal if s is None]


def taken_words(mix: Mix) -> DataFrame:
    """Each document with its size, its source's size and target, and the words the mix takes."""
    spark = mix.docs.sparkSession
    per_source = spark.createDataFrame([(q.source, q.size, q.target) for q in mix.quotas], "_s string, source_size bigint, target double")
    taken = mix.spans.groupBy("row_key").agg(F.sum("n").alias("taken"))
    return (
        mix.docs.join(taken.hint("merge"), "row_key", "left")
        .join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source")
    )


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs``'s columns with the text that the mix takes: a row for each document and epoch.

    A document that an epoch takes whole keeps its text as it is; of one that it takes in
    part, each run of taken words stands with the white space between them, runs joined by
    a space.  ``n_chars`` is the new text's length.  Documents the mix doesn't take go.  Of rows
    with one doc_id, source and text each has its own runs; their other columns are those of the
    row with the smallest values.
    """
    cols, key = docs.columns, ["doc_id", "source", "text_hash"]
    runs = mix.spans.groupBy(*key).agg(F.collect_list(F.struct("row_key", "epoch", "start", "n")).alias("__colonnade_runs"))
    runs = runs.select("__colonnade_runs", *[F.col(c).alias(f"__colonnade_{c}") for c in key])
    if mix.docs.groupBy(*key).count().where("count > 1").limit(1).count():
        rest = [c for c in cols if c not in key]
        docs = docs.groupBy("doc_id", "source", F.xxhash64("text").alias("__colonnade_h")).agg(F.min(F.struct(*rest)).alias("__colonnade_m")).select(*[F.col("__colonnade_m")[c].alias(c) if c in rest else F.col(c) for c in cols])
    ti, ni = cols.index("text"), cols.index("n_chars") if "n_chars" in cols else -1
    same = docs["doc_id"].cast("bigint").eqNullSafe(runs["__colonnade_doc_id"]) & docs["source"].cast("string").eqNullSafe(runs["__colonnade_source"]) & (F.xxhash64(docs["text"]) == runs["__colonnade_text_hash"])
    joined = docs.join(runs.hint("shuffle_hash"), same).select(*[docs[c] for c in cols], "__colonnade_runs")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for i, (text, runs) in enumerate(zip(b.column(ti).to_pylist(), b.column(len(cols)).to_pylist())):
                raw = text.encode()
                w = textops.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                by: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for r in sorted(runs, key=lambda r: (r["row_key"], r["epoch"], r["start"])):
                    own = by.setdefault((r["row_key"], r["epoch"]), [])
                    if own and own[-1][1] == r["start"]:
                        own[-1] = (own[-1][0], r["start"] + r["n"])
                    else:
                        own.append((r["start"], r["start"] + r["n"]))
                for own in by.values():
                    whole = own == [(0, len(w.start))]
                    texts.append(text if whole else b" ".join(raw[w.start[x] : w.end[y - 1]] for x, y in own).decode())
                    at.append(i)
            rows = b.take(pa.array(at, pa.int64()))
            out = [rows.column(i) for i in range(len(cols))]
            out[ti] = pa.array(texts, pa.string())
            if ni >= 0:
                out[ni] = pa.array([len(t) for t in texts], b.column(ni).type)
            yield pa.RecordBatch.from_arrays(out, names=cols)

    return joined.mapInArrow(cut, docs.schema)
