"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): each node of ``edges`` (``u``, ``v`` long) with its smallest reachable id.

    A step takes a minimum over each node's neighbours, writes it, and joins it back, so no task
    has to hold a node's neighbours together: Spark splits the join where a node has many.
    Loops and repeated edges are allowed.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", mark[0])
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges", mark[0])
        discard(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", mark[0])
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(least.select("u", F.col("m").alias("v")).union(small).distinct(), "edges", mark[0])
        for df in (large, least, now):
            discard(df)
        now, last = new, mark
        mark = _mark(now)
        if mark == last:
            break
    # now a star: each u points at its component's smallest id
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0
