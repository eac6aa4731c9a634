"""Connected components by alternating large-star and small-star, as joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of `edges` (u, v: long) that is not the smallest of its component.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path. Each
    round is written to the shared folder, so that a lost executor costs one round.
    """
    spark = edges.sparkSession
    now, before, k = shared.written(edges.where("u <> v"), folder, "edges-0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, k = mark, k + 1
        now = shared.written(small_star(large_star(now)), folder, f"edges-{k}")
        if k > 1:
            shared.remove(spark, f"{folder}/edges-{k - 1}")
