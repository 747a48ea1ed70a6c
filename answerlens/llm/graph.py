"""Connected components of a table of links, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, component), component the smallest node reachable; only nodes that have links.

    Each round takes the smallest label among a node and its neighbours and then
    the label of that label, so labels travel at doubling distances.  Every round is
    checkpointed; the driver sees only whether anything changed.  A node with very
    many links is one key of the joins, whose rows of 16 bytes adaptive execution
    splits; sums over neighbours are combined before they are shuffled.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        low = seen.unionByName(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
        of = low.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = low.join(of, low["component"] == of["_n"]).select(low["node"], F.least("component", "_c").alias("component"))
        old = labels.select("node", F.col("component").alias("_old"))
        nxt = cut(jumped.join(old, "node").select("node", "component", (F.col("component") != F.col("_old")).alias("moved")))
        changed = nxt.where("moved").limit(1).count()
        drop(labels)
        labels = nxt
        if not changed:
            return labels.select("node", "component")
