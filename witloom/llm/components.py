"""Connected components by least labels, as joins and aggregates over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

ROUNDS = 64


def components(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """node, component: the least ``weight`` reachable from each node that has an edge.

    ``edges``: columns a and b; ``weights``: node and weight. Every round takes the least label of the neighbours and
    then the label of the node that the label came from (labels travel as (weight, node) pairs), so paths shorten by
    about half a round. Nothing but a count of changed labels reaches the driver. More than ROUNDS rounds (paths far
    longer than near copies make) raise an error rather than return unfinished labels.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    nodes = both.select(F.col("a").alias("node")).distinct().join(weights, "node", "left")
    labels = stored(nodes.select("node", F.struct(F.coalesce(F.col("weight"), F.lit(2**63 - 1)).alias("w"), F.col("node").alias("n")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        least = stored(least, "least")
        roots = least.select(F.col("node").alias("root"), F.col("label").alias("of_root"))
        jumped = least.join(roots, F.col("label.n") == F.col("root"), "left").select("node", "was", F.least("label", "of_root").alias("label"))
        after = stored(jumped.select("node", "label", (F.col("was") != F.col("label")).alias("changed")), "labels")
        drop(least)
        drop(labels)
        labels = after.select("node", "label")
        labels._stored_at = after._stored_at
        if not after.where("changed").limit(1).count():
            break
    else:
        raise RuntimeError(f"labels still change after {ROUNDS} rounds")
    drop(both)
    return labels.select("node", F.col("label.w").alias("component"))
