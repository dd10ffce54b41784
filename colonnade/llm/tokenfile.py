"""Operator 10: token ids in ORC files.

Files hold one row per document in ascending ``doc_id`` order: ``doc_id``, the
ids as ``array<int>`` (stored by ORC's integer run-length encoding), their number, and
the ids before it in its file.  Row indexes and a Bloom filter on ``doc_id`` are written, so
readers work stripe by stripe in parallel and a search for a document reads only
stripes that may hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .shared import lean
from .tokens import worker_cache

FILE_SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, stripe_mb: int = 32, index_stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write the ids of every whole text of ``docs`` (``doc_id``, ``text``) as ORC under ``path``.

    ``end_id`` is appended to each document.  A null or empty text has the end id
    alone.  Rows with a null ``doc_id`` come first; rows that share one follow each
    other in the order of a hash of their texts, over several files if they are many; exact
    copies are written as often as they stand.  Other columns are ignored.  An empty table gives no rows.
    """

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer, spaced, lower=False)
        part, total = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, offs = textops.text_buffer(batch.column(1))
            for i, j in textops.slices(offs):
                got = [cache.ids(t or "") + end for t in batch.column(1).slice(i, j - i).to_pylist()]
                ends = np.cumsum([len(x) // 4 for x in got])
                ids = pa.array(np.frombuffer(b"".join(got), np.int32))
                rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), ids)
                before = total + np.append(0, ends[:-1])
                total += int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(before), pa.array(np.diff(np.append(0, ends))), rows], names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"])

    # The text goes through the shuffle, not its ids, which are larger.
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    # by a row's hash and number too, so that one id, or one row, that is most of the table is split
    dealt = rows.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n")
    (
        dealt.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "none")  # run-length encoding leaves little to compress
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files under ``path``; filters on ``doc_id`` prune stripes by index and Bloom filter."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def digest(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each row that was read back.

    A file's share of ``start`` comes from one row per file, of which there are no more
    than shuffle partitions at the writing.
    """

    @lean
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(4)
            offs = np.asarray(col.offsets)
            ids = memoryview(np.asarray(col.values).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(crc, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    per_file = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
