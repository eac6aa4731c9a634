"""Connected components by passing on the smallest label, in a loop of checkpointed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, component): the smallest node that can be reached. `edges` has columns a and b.

    Labels jump: each round takes the smallest label among neighbours, then the label of that label, so that long paths
    shrink by half. Each round is a reliable checkpoint where the session has a folder for it; without one it is kept in
    the executors' storage, which is given back a round later.
    """
    spark = nodes.sparkSession
    reliable, held = bool(spark.sparkContext.getCheckpointDir()), []

    def keep(df: DataFrame) -> DataFrame:
        if reliable:
            return df.checkpoint()
        held.append(df.persist())
        return held[-1]

    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both.where("a <> b"))
    labels = keep(nodes.select(F.col(node).alias("n"), F.col(node).alias("label")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["n"] == near["a"], "left").select("n", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        step = keep(step)
        jump = step.select(F.col("n").alias("m"), F.col("next").alias("far"))
        after = keep(step.join(jump, step["next"] == jump["m"]).select("n", "label", F.least("next", "far").alias("next")))
        changed = after.where("label <> next").limit(1).count()
        labels = after.select("n", F.col("next").alias("label"))
        while len(held) > 4:  # the edges, and what this round and its labels are read from
            held.pop(1).unpersist()
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("label").alias("component"))
