"""Connected components by least labels and pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def least_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge: the least node reachable from it.

    Each round takes the least label among a node's neighbours and then the label's own label,
    so a path shrinks by half at least; the number of rounds follows its logarithm. An edge of a
    node with itself and repeated edges do no harm; edges with a null end are left out.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label"))
    labels = written(labels, "labels")
    while True:
        heard = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["v"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(near.join(target, "label", "left").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels
