"""Connected components by minimum labels on edge tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node that it reaches.

    Each round every node takes the smallest label among itself and its neighbours, and then the label of its
    label (pointer jumping), so the rounds grow with the logarithm of the diameter. Every round is written to
    the shared folder. No edges: an empty result. Repeated edges and loops change nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), "edges", 8)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels", 8)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("hop"))
        own = written(own, "hops", 8)
        jump = own.select(F.col("node").alias("hop"), F.col("hop").alias("far"))
        after = written(own.join(jump, "hop").select("node", "old", F.least("hop", "far").alias("label")), "labels", 8)
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
