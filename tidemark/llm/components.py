"""Connected components over an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_path, materialize, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node it is connected with) for every node of edges(a, b).

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller ones; rounds end when
    the edges no longer change, after a number of them that grows with the logarithm of the longest path. Every round
    is written to shared storage. No node's neighbours are collected: minima are aggregated and joined back.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "stars")
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "stars", keep=path)
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = scratch_path(spark, "stars")
        now = materialize(small.where("a <> b").distinct(), "stars", keep=after)
        drop_path(spark, path)
        path = after
    ends = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp"))
    return ends.unionByName(ends.select(F.col("comp").alias("node"), "comp").distinct())
