"""Connected components of an edge table, by repeated contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node that can be reached, for each node of an edge.

    Each round sends every node to the smallest of itself and its neighbours, follows that pointer twice, and
    rewrites the edges; nodes that aren't a local minimum vanish, so the count at least halves and a few rounds do.
    The smallest node of a component never moves, so it is what remains. Rounds are cut by tables in the shared
    folder; the driver only learns whether edges are left. Nulls must not occur; loops and repeated edges are fine.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = write_table(both, "cc-edges")
    labels = None
    while not both.isEmpty():
        ends = both.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*")
        hook = write_table(ends.groupBy("node").agg(F.least("node", F.min("to")).alias("to")), "cc-hook")
        for _ in range(2):
            nxt = hook.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
            hook = hook.join(nxt, hook["to"] == nxt["_at"]).select("node", F.col("_next").alias("to"))
        hook = write_table(hook, "cc-jump")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            step = hook.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
            labels = labels.join(step, labels["component"] == step["_at"], "left").select("node", F.coalesce("_next", "component").alias("component"))
        labels = write_table(labels, "cc-labels")
        ha, hb = hook.select(F.col("node").alias("a"), F.col("to").alias("_a")), hook.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = both.join(ha, "a").join(hb, "b").where("_a <> _b")
        both = write_table(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "cc-edges")
    return edges.sparkSession.createDataFrame([], "node bigint, component bigint") if labels is None else labels
