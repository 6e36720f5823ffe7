"""Connected components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import discard, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key reachable over the edges (a, b), for every node of nodes.key.

    Each round takes the smallest label of a node's neighbours and then that label's own label, so that the rounds
    grow with the logarithm of a component's diameter; labels lie in the shared folder between rounds. Neighbours are
    pre-aggregated before the shuffle (a minimum), so a node with very many edges is no hot group. Earlier rounds are deleted. Edges whose ends are
    no nodes are ignored; repeated edges and loops do no harm; without edges every node is its own label.
    """
    both = written(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = nodes.select("key").distinct().select("key", F.col("key").alias("label"))
    first, last = True, []
    while True:
        # In the first round a label is the node itself: no join is needed for it.
        seen = (both.select(F.col("b").alias("key"), F.col("a").alias("near")) if first else both.join(label, both.a == label.key).select(F.col("b").alias("key"), F.col("label").alias("near"))).groupBy("key").agg(F.min("near").alias("near"))
        step = label.join(seen, "key", "left").select("key", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        if not first:
            further = label.select(F.col("key").alias("to"), F.col("label").alias("further"))
            step = step.join(further, "to", "left").select("key", F.least("to", "further").alias("to"), "was")
        new = written(step.select("key", F.col("to").alias("label"), (F.col("to") != F.col("was")).alias("changed")))
        discard(*last)
        last = [new]
        if new.where("changed").isEmpty():
            discard(both)
            return new.select("key", "label")
        label, first = new.select("key", "label"), False
