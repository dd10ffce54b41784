"""Operator 4: packing documents into sequences by the sum-of-squares rule.

Documents' lengths in tokens are items, sequences are bins.  An item goes to the
place after which the sum over residual gaps of (open bins with that gap) squared is
smallest; ties go to the tighter gap.  Shards of pieces, dealt by a hash, are packed
independently; bins that a shard leaves unfilled are items of the next round, in
which bins of many shards are put together, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import lean, written
from .tokens import worker_cache

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the given order; bins count from 0.

    For an item of length s and a gap g of an open bin, moving the bin from gap g to
    g - s changes the sum of squares by 2 (N[g-s] - N[g]) + 2, where an end at
    either gap 0 or a fresh bin leaves out its own term.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # gap s: the bin becomes full and leaves the sum
        best, at = (1 - 2 * count[s], s) if s < size and count[s] else (far, -1)
        if s < size:
            fresh = 2 * count[size - s] + 1
            if at < 0 or fresh < best:
                best, at = fresh, size
            if s + 1 < size:
                here = count[s + 1 : size]
                delta = 2 * (count[1 : size - s] - here) + 2
                delta[here == 0] = far
                j = int(delta.argmin())
                if delta[j] < best or (at == size and delta[j] == best and delta[j] != far):
                    best, at = delta[j], s + 1 + j
        else:
            at = size
        if at == size:
            b, made = made, made + 1
        else:
            b = open_bins[at].pop()
            count[at] -= 1
        bins[i], offsets[i] = b, size - at
        if at > s:
            open_bins[at - s].append(b)
            count[at - s] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, spaced: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: only a longer document is cut."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer, spaced, lower=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, offs = textops.text_buffer(batch.column(1))
            for i, j in textops.slices(offs):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                out = [[], [], [], [], []]
                for doc, x in zip(ids, batch.column(1).slice(i, j - i).to_pylist()):
                    got = memoryview(cache.ids(x or "") + end)
                    for p, a in enumerate(range(0, len(got), 4 * size)):
                        part = got[a : a + 4 * size]
                        for column, v in zip(out, (doc, p, a // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, size: int, shard_items: int = 16_384) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``length`` from 1 to ``size``).

    A shard holds about ``shard_items`` items whatever the table's size, so no task's
    memory grows with it.
    """
    df = written(pieces, "pieces")
    n = df.count()
    shards = max(1, -(-n // shard_items))
    # by a number of the row in the written table, so that equal rows are dealt to many shards
    item = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("bigint")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *[c for c in pdf.columns if c not in ("length", "shard")]], ascending=[False] + [True] * (len(pdf.columns) - 2), kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["bin"] = (np.int64(pdf["shard"].iloc[0]) << 32) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", bin bigint, offset bigint"
    placed = written(df.withColumn("shard", item).groupBy("shard").applyInPandas(first, schema), "placed")
    fills = placed.groupBy("bin").agg(F.sum("length").alias("length"))
    moves = None
    while shards > 1:
        # bins with room left, as items: one group for each shard_items bins expected
        loose = fills.where(F.col("length") < size)
        m = loose.count()
        groups = max(1, -(-m // shard_items))
        if groups >= shards:
            break
        shards = groups

        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "bin"], ascending=[False, True], kind="stable")
            bins, offsets = sum_of_squares(pdf["length"].to_numpy(), size)
            # a merged bin keeps the id of the bin at its start
            head = np.zeros(bins.max() + 1, np.int64)
            own = pdf["bin"].to_numpy()
            head[bins[offsets == 0]] = own[offsets == 0]
            return pd.DataFrame({"bin": own, "into": head[bins], "shift": offsets, "length": pdf["length"].to_numpy()})

        step = written(loose.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("g").applyInPandas(again, "bin bigint, into bigint, shift bigint, length bigint"), "moves")
        if moves is None:
            moves = step.select("bin", "into", "shift")
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("into2"), F.col("shift").alias("shift2"))
            moves = moves.join(later, "into", "left").select("bin", F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        fills = step.groupBy(F.col("into").alias("bin")).agg(F.sum("length").alias("length"))
    if moves is None:
        return placed.withColumnRenamed("bin", "sequence_id")
    return placed.join(moves, "bin", "left").select(*pieces.columns, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, spaced: bool = False, shard_items: int = 16_384) -> DataFrame:
    """Pack every whole text of ``docs`` (``doc_id``, ``text``) into sequences of at most ``size`` tokens.

    Each piece's row: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end id alone.  A null ``doc_id`` is kept as null; rows
    that are repeated are packed as often as they stand.  Only ``doc_id`` and ``text``
    are read.  An empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, size, end_id, spaced), size, shard_items)
