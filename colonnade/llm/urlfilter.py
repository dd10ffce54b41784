"""Operator 9: URL filter by rules and a character language-model ratio.

Two variable-order Markov models over characters, one of URLs to accept and one of URLs
to reject, give a URL the difference of their log-likelihoods divided by its length.
The threshold is calibrated on labelled URLs that the models didn't learn from.

All labelled URLs are learned from, on the cluster, and no machine holds a model: what
a model says depends on a *gram*, a character and the ``order`` characters before it.  Distinct
grams are dealt by the last ``SHARED`` characters of their contexts, so a task has all counts of
the contexts that are as long or longer; those of shorter ones, which the alphabet
bounds, are broadcast.  Blocks of URLs then fetch the values of their grams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import discard, prefix_sums, written

ALLOW, BLOCK = "allow", "block"
#: Contexts shorter than this are broadcast.
SHARED = 2


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse(text: str) -> Rule:
    verdict, at = text.split()
    host, _, path = at.partition("/")
    return Rule(verdict, host, "/" + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), F.substr(rest, F.instr(rest, "/"))), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null; of rules as long as each other the first listed."""
    out = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


@dataclass
class MarkovModel:
    """Interpolated Witten-Bell model: each order is smoothed with the one below it."""

    order: int
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def learn(self, text: str) -> None:
        text = "\x02" * self.order + text + "\x03"
        for i in range(self.order, len(text)):
            for k in range(self.order + 1):
                own = self.counts.setdefault(text[i - k : i], {})
                own[text[i]] = own.get(text[i], 0) + 1

    def log_likelihood(self, text: str) -> float:
        text = "\x02" * self.order + text + "\x03"
        total = 0.0
        for i in range(self.order, len(text)):
            p = 1.0 / 0x110000
            for k in range(self.order + 1):
                own = self.counts.get(text[i - k : i])
                if own is None:
                    break
                n, kinds = self._totals(text[i - k : i], own)
                p = (own.get(text[i], 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total

    def _totals(self, context: str, own: dict[str, int]) -> tuple[int, int]:
        if not hasattr(self, "_sums"):
            self._sums: dict[str, tuple[int, int]] = {}
        if context not in self._sums:
            self._sums[context] = (sum(own.values()), len(own))
        return self._sums[context]


def grams(text: str, order: int) -> list[str]:
    """Each character of ``text`` and its end, with the ``order`` characters before it."""
    text = "\x02" * order + text + "\x03"
    return [text[i : i + order + 1] for i in range(len(text) - order)]


def count_grams(learned: DataFrame, order: int) -> DataFrame:
    """``gram`` and how often ``learned`` (``url``, ``verdict``) has it for each verdict: ``n_allow``, ``n_block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offs = textops.text_buffer(b.column(0))
            for i, j in textops.slices(offs):
                found: dict[str, Counter] = {ALLOW: Counter(), BLOCK: Counter()}
                for url, v in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()):
                    found[v].update(grams(url, order))
                own = list(found[ALLOW].keys() | found[BLOCK].keys())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array([found[v][g] for g in own], pa.int64()) for v in (ALLOW, BLOCK))], names=["gram", "n_allow", "n_block"])

    return learned.select("url", "verdict").mapInArrow(run, "gram string, n_allow bigint, n_block bigint").groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))


def _codes(texts: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each text, equal ones alike, and how many there are."""
    coded = texts.dictionary_encode()
    return np.asarray(coded.indices), len(coded.dictionary)


def _witten_bell(p: np.ndarray, counts: np.ndarray, context: np.ndarray, pair: np.ndarray, n_contexts: int, n_pairs: int) -> np.ndarray:
    """One order more: ``p`` smooths the counts of ``pair`` (a context and a character) in ``context``; rows of 0 are asked for only."""
    of_pair = np.bincount(pair, counts, n_pairs)
    of_context = np.bincount(context, counts, n_contexts)
    place = np.empty(n_pairs, np.int64)
    place[pair] = context
    kinds = np.bincount(place, of_pair > 0, n_contexts)[context]
    total = of_context[context]
    return np.where(total > 0, (of_pair[pair] + kinds * p) / np.maximum(total + kinds, 1), p)


def gram_values(all_grams: DataFrame, short: DataFrame, order: int, task_grams: int = 1 << 16) -> DataFrame:
    """``gram`` and ``value``, the difference of both models' log-probabilities, for all of ``all_grams`` (``gram``, ``n_allow``, ``n_block``).

    Models are counted from ``all_grams`` too, where a gram that was not learned has 0.  ``short`` has
    the learned counts of ``gram``s cut to their last ``SHARED`` characters.  A task takes ``task_grams``
    at once, or all that share the end of a context if they are more.
    """
    known = min(SHARED, order + 1)  # contexts of fewer characters are in ``short``
    rows = short.collect()  # bounded by the alphabet: pairs of characters
    table = pa.table({"gram": pa.array([r["gram"] for r in rows], pa.string()), "n_allow": pa.array([r["n_allow"] for r in rows], pa.int64()), "n_block": pa.array([r["n_block"] for r in rows], pa.int64())})
    shared = all_grams.sparkSession.sparkContext.broadcast(table)

    def both_codes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        pair, n_pairs = _codes(pc.utf8_slice_codeunits(texts, -k - 1))
        context, n_contexts = _codes(pc.utf8_slice_codeunits(texts, -k - 1, -1))
        return context, pair, n_contexts, n_pairs

    def values(t: pa.Table) -> pa.RecordBatch:
        m = len(t)
        more = shared.value
        own = t.column(0).combine_chunks().cast(pa.string())
        both = pa.chunked_array([own, *more.column(0).chunks], pa.string()).combine_chunks()
        logs = []
        for side in (1, 2):
            counts = t.column(side).to_numpy()
            p = np.full(m + len(more), 1.0 / 0x110000)
            ahead = np.append(np.zeros(m, np.int64), more.column(side).to_numpy())
            for k in range(known):
                p = _witten_bell(p, ahead, *both_codes(both, k))
            p = p[:m]
            for k in range(known, order + 1):
                p = _witten_bell(p, counts, *both_codes(own, k))
            logs.append(np.log(p))
        return pa.RecordBatch.from_arrays([own, pa.array(logs[0] - logs[1])], names=["gram", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            if n >= task_grams:
                # up to where the last of what is held ends; the sort is by the end of the context
                last = held[-1].column(3)[-1].as_py()
                same = np.asarray(pc.equal(b.column(3), last).cast(pa.int8()))
                cut = int(same.argmin()) if not same.all() else b.num_rows
                held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield values(pa.Table.from_batches(held))
                    held, n = [b.slice(cut)], 0
            else:
                held.append(b)
            n += b.num_rows
        if held:
            yield values(pa.Table.from_batches(held))

    end = F.substring("gram", order + 1 - min(SHARED, order), min(SHARED, order))
    dealt = all_grams.select("gram", "n_allow", "n_block", end.alias("end")).repartition("end").sortWithinPartitions("end")
    return dealt.mapInArrow(run, "gram string, value double")


def in_blocks(rows: DataFrame, url: int) -> DataFrame:
    """``rows`` with ``block``, a number that rows share whose URLs (column ``url``) hold about 256 KB, or one row has."""
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            _, offs = textops.text_buffer(b.column(url))
            for i, j in textops.slices(offs, 1 << 18):
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(np.full(j - i, block))], names=schema.names)
                block += 1

    return rows.mapInArrow(run, schema)


def with_ratios(rows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``rows`` (with ``url``) with ``ratio``: the log-likelihood difference per character; an empty or null URL has 0."""
    at = rows.columns.index("url")
    blocks = written(in_blocks(rows, at), "url_blocks")
    out = T.StructType([*rows.schema.fields, T.StructField("ratio", T.DoubleType())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs):
                part = b.slice(i, j - i)
                by: dict[int, set[str]] = {}
                for block, url in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if url:
                        by.setdefault(block, set()).update(grams(url, order))
                own = [g for x in by.values() for g in x]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(by), np.int64), [len(x) for x in by.values()])), pa.array(own, pa.string())], names=["block", "gram"])

    def ratios(mine: pa.Table, known: pa.Table) -> pa.Table:
        value = dict(zip(known.column("gram").to_pylist(), known.column("value").to_pylist()))
        found = [math.fsum(map(value.__getitem__, grams(u, order))) / (len(u) + 1) if u else 0.0 for u in mine.column(at).to_pylist()]
        return pa.table([*mine.columns[:-1], pa.array(found, pa.float64())], names=out.names)

    wanted = written(blocks.select("block", "url").mapInArrow(asked, "block bigint, gram string"), "url_grams")
    zero = F.lit(0).cast("bigint")
    every = counts.unionByName(wanted.select("gram", zero.alias("n_allow"), zero.alias("n_block"))).groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    short = counts.groupBy(F.right("gram", F.lit(SHARED)).alias("gram")).agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    answers = wanted.join(gram_values(every, short, order), "gram").select("block", "gram", "value")
    done = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ratios, out), "url_ratios")
    discard(wanted)
    discard(blocks)
    return done


def calibrate(held: DataFrame) -> float:
    """The threshold with the fewest errors among ``held`` (``verdict``, ``ratio``), each class weighing the same; the lowest of equals.

    URLs at or above it are accepted.  Without both classes it is 0.  Ratios are sorted and counted on the cluster.
    """
    is_a = F.col("verdict") == ALLOW
    by = held.groupBy("ratio").agg(F.count(F.when(is_a, 1)).alias("a"), F.count(F.when(~is_a, 1)).alias("b"))
    all_a, all_b = by.agg(F.sum("a"), F.sum("b")).first()
    if not all_a or not all_b:
        return 0.0
    # a threshold at a ratio has as many errors, times both classes' sizes, as one below all ratios and this sum of what is lower
    step = (F.col("a") * all_b - F.col("b") * all_a).alias("step")
    sums = prefix_sums(by.select("ratio", step), [], ["ratio"], "step", "errors", "url_threshold")
    at = sums.agg(F.min(F.struct("errors", "ratio")).alias("m")).first()["m"]["ratio"]
    lower = sums.where(F.col("ratio") < at).agg(F.max("ratio")).first()[0]
    discard(sums)
    return at if lower is None else max((lower + at) / 2, math.nextafter(lower, math.inf))


@dataclass
class UrlClassifier:
    """Learned counts of grams (:func:`count_grams`) and the threshold."""

    counts: DataFrame
    order: int
    threshold: float

    def ratio(self, url: str) -> float:
        """Log-likelihood difference per character; an empty URL has 0."""
        one = self.counts.sparkSession.createDataFrame([(url,)], "url string")
        return with_ratios(one, self.counts, self.order).first()["ratio"]


def is_held() -> Column:
    """Labelled URLs that the models don't learn from: every fifth by hash."""
    return F.xxhash64("url") % 5 == 0


def has_both(labelled: DataFrame) -> bool:
    return labelled.select("verdict").distinct().count() == 2


def learn(labelled: DataFrame, order: int = 5, most: int | None = None) -> UrlClassifier | None:
    """Models and threshold from the distinct URLs of ``labelled`` (``url``, ``verdict``); nulls take no part.

    Every fifth of them by hash is held out to calibrate the threshold.  None if a verdict
    has no URL.  With ``most``, only so many URLs of each verdict are used, those with the smallest hashes.
    """
    rows = labelled.where(F.col("url").isNotNull()).select("url", "verdict").distinct()
    if most is not None:
        allow, block = (rows.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(most) for v in (ALLOW, BLOCK))
        rows = allow.union(block)
    if not has_both(rows):
        return None
    counts = written(count_grams(rows.where(~is_held()), order), "url_counts")
    return UrlClassifier(counts, order, calibrate(with_ratios(rows.where(is_held()), counts, order)))


def judge(pages: DataFrame, rules: list[Rule], order: int = 5) -> DataFrame:
    """Every row of ``pages`` (``page_id``, ``url``) with host, path, rule, verdict and ratio.

    A URL that a rule fits has the rule's verdict; these URLs are the labelled examples from
    which the models for the others are learned, all of them but the held-out fifth that
    calibrates the threshold.  Where they show one verdict only, all other
    URLs are allowed, with ratio 0.  A null URL has an empty host and path, fits no rule, and is judged
    as an empty text with ratio 0.  Other columns are ignored; repeated rows are judged alike, and
    learned from once.  An empty table gives no rows.
    """
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])
    parsed = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", F.try_element_at(verdicts, F.col("rule")))
    labelled = parsed.where("rule IS NOT NULL").select("url", "verdict").distinct()
    if not has_both(labelled):
        return parsed.withColumn("verdict", F.coalesce("verdict", F.lit(ALLOW))).withColumn("ratio", F.lit(0.0))
    counts = written(count_grams(labelled.where(~is_held()), order), "url_counts")
    scored = with_ratios(parsed, counts, order)
    discard(counts)
    cut = calibrate(scored.where(F.col("rule").isNotNull() & is_held()).select("url", "verdict", "ratio").distinct())
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("ratio") >= cut, ALLOW).otherwise(BLOCK)))
