"""Ordered streams of messages: frames, a dictionary that outlives messages, patch streams.

A message has ``stream_id``, ``seq`` (its place in the stream) and a value.  Streams are
independent of each other; state is kept by ``stream_id`` and cleared by an envelope's reset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import BaselineRequiredError, InvalidPatchError
from ..operators.delta import DELETE
from ..operators.order import numbered, with_running_sum

BUCKETS = 256
_SLICE = 16_384
_MESSAGE = pa.schema([("seq", pa.int64()), ("value", pa.string()), ("reset", pa.bool_())])
MESSAGES = "stream_id bigint, seq bigint, value string, reset boolean"


def frames(spark: SparkSession, path: str, schema: str = MESSAGES, files_per_batch: int = 1) -> DataFrame:
    """A file source whose micro-batches are groups of frames in the order of their files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_frames(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append the stream to files and stop when it is drained; a failure commits nothing."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def encode_dictionary(stream: DataFrame) -> DataFrame:
    """(stream_id, seq, id, value): the id of each message's value in its stream's dictionary.

    The value itself comes with the message that brings it in, as later ones refer to it.
    Ids count from 0 in the order of ``seq``; a reset message starts a new dictionary before it.  A
    task holds a stream's messages of one micro-batch, which the source's rate bounds, and its
    dictionary.  Values aren't null.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else []
        ids = {v: i for i, v in enumerate(values)}
        # texts as Arrow has them, not an object for each message
        rows = pa.concat_tables([pa.Table.from_pandas(p[["seq", "value", "reset"]], _MESSAGE, preserve_index=False) for p in pdfs]).sort_by("seq")
        for b in rows.to_batches(_SLICE):
            out = []
            for seq, value, reset in zip(*(c.to_pylist() for c in b.columns)):
                if reset:
                    values, ids = [], {}
                new = value not in ids
                if new:
                    ids[value] = len(values)
                    values.append(value)
                out.append((key[0], seq, ids[value], value if new else None))
            yield pd.DataFrame(out, columns=["stream_id", "seq", "id", "value"])
        state.update((values,))

    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, seq bigint, id bigint, value string", "vals array<string>", "append", GroupStateTimeout.NoTimeout)


def decode_dictionary(encoded: DataFrame) -> DataFrame:
    """(stream_id, seq, value) from a table of encoded messages.

    A dictionary begins with the message that brings in id 0, and each of its ids is brought in once,
    so a message is joined with one definition.  Dictionaries are numbered by a running count over
    the whole table in order, which many tasks share.
    """
    rows = numbered(encoded, "stream_id", "seq")
    rows = with_running_sum(rows, F.when((F.col("id") == 0) & F.col("value").isNotNull(), 1).otherwise(0), "_dictionary")
    given = rows.where("value IS NOT NULL").select("_dictionary", "id", F.col("value").alias("_value"))
    return rows.select("stream_id", "seq", "id", "_dictionary").join(given, ["_dictionary", "id"], "left").select("stream_id", "seq", F.col("_value").alias("value"))


def apply_patch_stream(stream: DataFrame) -> DataFrame:
    """(entity, seq, version, value): state of each entity after each patch of a stream.

    Entities are dealt to ``BUCKETS``, as each call and each state has its price; a task holds a bucket's
    patches of one micro-batch, and its entities' versions.

    Patches: entity, seq, op (insert, update, delete), base (the version it is for; null for an
    insert), value.  A patch for a version other than the entity's is an error, one without
    a base where the entity is known too.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions = dict(zip(*state.get)) if state.exists else {}
        null = pd.isna(key[0])
        rows = pd.concat(pdfs)
        rows = rows.sort_values("seq") if null else rows.sort_values(["entity", "seq"])
        code, entities = (np.zeros(len(rows), np.int64), [None]) if null else pd.factorize(rows["entity"])
        seq, base = rows["seq"].to_numpy(), rows["base"].to_numpy(np.float64)
        entities = [None if e is None else int(e) for e in entities]
        first = np.searchsorted(code, np.arange(len(entities)))  # codes ascend
        before = np.array([versions.get(e, 0) for e in entities], np.int64)[code] + np.arange(len(code)) - first[code]
        absent = np.isnan(base)
        bad = np.where(absent, before > 0, base != before)
        if bad.any():
            i = int(bad.argmax())
            at = f"entity {entities[code[i]]}, message {seq[i]}"
            if absent[i]:
                raise BaselineRequiredError(at)
            raise InvalidPatchError(f"{at}: for version {base[i]:.0f}, not {before[i]}")
        last = np.append(first[1:], len(code)) - 1
        versions.update(zip(entities, (before[last] + 1).tolist()))
        state.update((list(versions), list(versions.values())))
        # an integer column with a null would be one of floats
        entity = pd.Series([None] * len(rows), dtype="Int64") if null else rows["entity"].to_numpy()
        yield pd.DataFrame({"entity": entity, "seq": seq, "version": before + 1, "value": np.where(rows["op"] == DELETE, None, rows["value"])})

    bucket = F.when(F.col("entity").isNotNull(), F.pmod(F.xxhash64("entity"), F.lit(BUCKETS)))
    return stream.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(step, "entity bigint, seq bigint, version bigint, value string", "entities array<bigint>, versions array<bigint>", "append", GroupStateTimeout.NoTimeout)
