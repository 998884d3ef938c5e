"""Connected components by repeated contraction.

Each round maps every vertex of the remaining graph to its smallest
neighbour, follows that pointer once more, and contracts the edges; the
graph shrinks at least by half, stars in one round. The sides of every join
are written tables with no partitioning of their own, so the adaptive
planner sees two plain exchanges and can split the partition of a hub.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contract_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame],
                        src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label = smallest node of
    its component. ``save(df, name)`` materialises a round's table on shared
    storage. Nodes are any orderable type; self loops are ignored."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct()
    e = save(e, "edges-0")
    labels = None
    step = 0
    while not e.isEmpty():
        step += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least(a, min neighbour): partial aggregation leaves one row per
        # task for a hub.
        p = save(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select("a", F.least("a", "m").alias("p")), f"parent-{step}")
        q = p.select(F.col("a").alias("p"), F.col("p").alias("g"))
        p2 = save(p.join(q, "p").select("a", F.least("p", "g").alias("p")), f"jump-{step}")
        if labels is None:
            labels = p2.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            nxt = p2.select(F.col("a").alias("label"), F.col("p").alias("nl"))
            labels = labels.join(nxt, "label", "left").select(
                "node", F.coalesce("nl", "label").alias("label"))
        labels = save(labels, f"labels-{step}")
        pa = p2.select(F.col("a"), F.col("p").alias("pa"))
        pb = p2.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = save(e.join(pa, "a").join(pb, "b").filter("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                 .distinct(), f"edges-{step}")
    if labels is None:
        t = edges.schema[src].dataType
        labels = edges.limit(0).select(F.col(src).cast(t).alias("node"),
                                       F.col(src).cast(t).alias("label"))
    return labels
