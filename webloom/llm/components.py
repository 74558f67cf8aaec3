"""Connected components by min-label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for each node of an edge.

    Every round takes the least label of the neighbours, then the label of the
    label, so the rounds grow with the logarithm of the longest path in
    practice. Rounds are cut with checkpoints; only a count reaches the driver.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("to"))
    both = cut(both.unionByName(both.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), F.col("component").alias("seen")), "to").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.filter(F.col("component") != F.col("old")).limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
