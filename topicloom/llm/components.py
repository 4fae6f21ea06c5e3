"""Connected components of an edge table, by smallest label and pointer jumping, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge; root is the smallest node that can be reached.

    A round takes the smallest label among a node and its neighbours, lowers the label of the old label as well, and
    lets each label follow its own label. Hubs cost no more than their edges: minima are combined before the shuffle.
    Empty edges give an empty table; nulls and loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = materialize(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "root")
        own = labels.select("node", "root")
        # The label of a node's label is lowered with the node: whole trees move at once.
        lowered = near.groupBy("node").agg(F.min("root").alias("near")).join(own, "node")
        hooked = lowered.select(F.col("root").alias("node"), F.least("near", "root").alias("root"))
        first = own.union(lowered.select("node", F.least("near", "root").alias("root"))).union(hooked)
        best = materialize(first.groupBy("node").agg(F.min("root").alias("root")), "labels")
        up = best.select(F.col("node").alias("parent"), F.col("root").alias("higher"))
        after = materialize(
            best.join(up, best.root == up.parent, "left").select("node", F.coalesce("higher", "root").alias("root")), "labels"
        )
        moved = after.withColumnRenamed("root", "now").join(labels, "node").filter("now <> root").limit(1).count()
        labels = after
        if not moved:
            return labels
