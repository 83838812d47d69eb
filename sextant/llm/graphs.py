"""Connected components of large sparse graphs by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import narrow, save, skew_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round takes the least label among neighbours, then the label's own
    label, and writes a table; the rounds grow with the logarithm of a
    component's diameter. Nothing but the number of changes reaches the driver.
    """
    both = narrow(save(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct()))
    join = skew_join if both.rdd.getNumPartitions() > 1 else lambda x, y, on: x.join(y, on)
    labels = narrow(save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))))
    while True:
        heard = join(both.withColumnRenamed("a", "node"), labels, ["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        better = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("least"))
        own = labels.select(F.col("node").alias("least"), F.col("label").alias("jump"))
        new = save(join(better, own, ["least"]).select("node", "label", F.least("least", "jump").alias("new")))
        done = new.where("label <> new").isEmpty()
        labels = narrow(new.select("node", F.col("new").alias("label")))
        if done:
            return labels
