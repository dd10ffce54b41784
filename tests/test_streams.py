"""State that outlives micro-batches, resets, and patches that don't fit."""

import pytest
from pyspark.sql import functions as F

from colonnade import streaming
from colonnade.sources import shared_folder


def drained(spark, tmp, batches, schema, fn):
    """Each of ``batches`` is a file of its own, and so a micro-batch."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        time.sleep(0.05)
    out = fn(streaming.frames(spark, f"{tmp}/in", schema))
    streaming.write_frames(out, f"{tmp}/out", f"{tmp}/log")
    return spark.read.schema(out.schema).parquet(f"{tmp}/out")


def test_dictionary_outlives_batches(spark, tmp_path):
    shared_folder(spark)
    batches = [
        [(1, 0, "a", False), (1, 1, "b", False), (2, 0, "b", False)],
        [(1, 2, "a", False), (1, 3, "c", False)],
        [(1, 4, "c", True), (1, 5, "a", False), (2, 1, "b", False)],
    ]
    got = drained(spark, tmp_path, batches, streaming.MESSAGES, streaming.encode_dictionary).collect()
    assert sorted((r["stream_id"], r["seq"], r["id"], r["value"]) for r in got) == [
        (1, 0, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, None), (1, 3, 2, "c"), (1, 4, 0, "c"), (1, 5, 1, "a"), (2, 0, 0, "b"), (2, 1, 0, None),
    ]
    back = streaming.decode_dictionary(spark.createDataFrame(got)).collect()
    assert sorted((r["stream_id"], r["seq"], r["value"]) for r in back) == sorted((s, q, v) for b in batches for s, q, v, _ in b)


PATCHES = "entity bigint, seq bigint, op string, base bigint, value string"


def test_patches(spark, tmp_path):
    batches = [[(7, 0, "insert", None, "x")], [(7, 1, "update", 1, "y"), (8, 2, "insert", None, "z")], [(7, 3, "delete", 2, None)]]
    got = drained(spark, tmp_path, batches, PATCHES, streaming.apply_patch_stream).collect()
    assert sorted((r["entity"], r["seq"], r["version"], r["value"] or "") for r in got) == [(7, 0, 1, "x"), (7, 1, 2, "y"), (7, 3, 3, ""), (8, 2, 1, "z")]


@pytest.mark.parametrize("bad", [(7, 1, "update", 5, "y"), (7, 1, "update", None, "y")])
def test_patch_for_another_version_stops_the_stream(spark, tmp_path, bad):
    with pytest.raises(Exception, match="entity 7"):
        drained(spark, tmp_path, [[(7, 0, "insert", None, "x")], [bad]], PATCHES, streaming.apply_patch_stream)


def test_patches_of_a_bucket(spark, tmp_path, monkeypatch):
    """A call has many entities of a stream, null among them, and all patches of a micro-batch; each entity has its versions."""
    import random

    r, versions, batches, seq = random.Random(1), {}, [], 0
    for _ in range(3):
        rows = []
        for _ in range(60):
            e = r.choice([None, -1, 0, 2**60 + 1, 2**60 + 2, *range(5, 20)])
            rows.append((e, seq, "update" if e in versions else "insert", versions.get(e), r.choice("xyz")))
            versions[e] = versions.get(e, 0) + 1
            seq += 1
        batches.append(rows)
    monkeypatch.setattr(streaming, "BUCKETS", 2)
    got = drained(spark, tmp_path, batches, PATCHES, streaming.apply_patch_stream).collect()
    assert sorted((g["seq"], g["entity"], g["version"], g["value"]) for g in got) == [(q, e, (b or 0) + 1, v) for x in batches for e, q, _, b, v in x]


def test_output_comes_in_slices(spark, tmp_path, monkeypatch):
    """A stream's output isn't held whole, and more micro-batches take what a task's share would outgrow."""
    from colonnade.plans import catalogue

    monkeypatch.setattr(streaming, "_SLICE", 3)
    monkeypatch.setattr(catalogue, "BATCH_ROWS", 20)
    rows = spark.range(100).select(F.lit(0).cast("bigint").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("value"), (F.col("id") == 50).alias("reset"))
    got = catalogue._drained(spark, rows, "seq", streaming.MESSAGES, streaming.encode_dictionary)
    assert [(g["id"], g["value"]) for g in got.orderBy("seq").collect()] == [((i - 50 * (i >= 50)) % 7, str(i % 7) if i % 50 < 7 else None) for i in range(100)]
    import glob

    path = got.inputFiles()[0].removeprefix("file://").rsplit("/out/", 1)[0]
    assert len([x for x in glob.glob(f"{path}/log/commits/*") if x.rsplit("/", 1)[1].isdigit()]) == 5
