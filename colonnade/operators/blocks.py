"""A bounded set of blocks held by tasks, met by every block of queries."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_blocks(df: DataFrame, key: str, column: str, rows: int, dtype: str = "f8", build: Callable | None = None) -> tuple[DataFrame, int]:
    """((block, payload), number of blocks): rows dealt by a hash of ``key`` into blocks of about ``rows``, each
    the pickled ids and matrix of its vectors (which have one length), or what ``build`` makes of these."""
    blocks = max(1, -(-df.count() // rows))

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        x = np.asarray(lists.flatten()).reshape(len(lists), -1).astype(dtype)
        got = (table.column("id").to_numpy(), x)
        return pa.table({"block": table.column("block").slice(0, 1), "payload": pa.array([pickle.dumps(build(*got) if build else got)], pa.binary())})

    dealt = df.select(F.col(key).cast("bigint").alias("id"), F.col(column).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, payload binary"), blocks


def copied(asked: DataFrame, blocks: int) -> DataFrame:
    """Blocks of queries once for each of ``blocks`` held ones."""
    return asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "payload")


def meet(held: DataFrame, asked: DataFrame, on: list[str], tasks: int, fn: Callable[[object, object], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn(held, asked)`` of the payloads of every two rows with the same ``on``.

    ``held`` has one row for each ``on``: it goes to one task and stays there, while the queries' blocks,
    copied to each (see :func:`copied`), pass by one at a time.  What is shuffled is the held blocks
    once and the queries, which are stated and fewer, as often as there are held blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(on)))))
            for key, query, raw in zip(keys, b.column(len(on)).to_pylist(), b.column(len(on) + 1)):
                if not query:
                    at, now = key, pickle.loads(raw.as_py())
                elif at == key:  # else nothing is held there
                    yield fn(now, pickle.loads(raw.as_py()))

    rows = held.select(*on, F.lit(False).alias("query"), "payload").unionByName(asked.select(*on, F.lit(True).alias("query"), "payload"))
    return rows.repartition(tasks, *on).sortWithinPartitions(*on, "query").mapInArrow(run, schema)
