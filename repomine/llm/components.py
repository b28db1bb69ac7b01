"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.session import cut_lineage

# Every round at least halves the longest chain of hubs, so this many are enough for any graph.
MAX_ROUNDS = 64


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest node around it.

    The smallest neighbour is counted first, with partial sums, and joined back: no list of neighbours is
    built, so a node with millions of them is rows in several tasks, not one group.
    """
    if larger_only:
        around = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        around = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
    hubs = around.groupBy("node").agg(F.min("other").alias("hub")).withColumn("hub", F.least("hub", "node"))
    # Written, so that the join has an exchange of its own that adaptive execution can split at a hot node.
    hubs = cut_lineage(hubs)
    tied = around.join(hubs, "node")
    if larger_only:
        pairs = tied.select(F.col("other").alias("a"), F.col("hub").alias("b")).union(
            hubs.select(F.col("node").alias("a"), F.col("hub").alias("b"))
        )
    else:
        pairs = tied.where("other > node").select(F.col("other").alias("a"), F.col("hub").alias("b"))
    return pairs.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (bigint), ``root`` the smallest node reachable.

    Alternating large and small stars until nothing changes. The links of each round are written to the
    shared folder, so a lost executor repeats one round. Nodes without links are not returned; links of a
    node to itself and repeated links are ignored, rows with a null on either side too.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = cut_lineage(_stars(_stars(now, larger_only=False), larger_only=True))
    else:
        raise RuntimeError("the components did not settle")
    # Settled links are stars: every node but the root is on the left once.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
