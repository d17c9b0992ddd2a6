"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowwatch.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of the edges (a, b); root is one node of the component.

    Each round moves every node to its smallest neighbour's smallest neighbour and rewrites the
    edges. Nodes are hashes, so smallest is a random choice and a constant share of the nodes is
    expected to vanish in each round, whatever the shape of the graph. Minima are combined before
    the shuffle and joins with a hub's edges can be split, so a hub needs no task of its own. Each
    round is written to the shared folder: a lost executor costs the round it is in.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ends.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low")).select("at", F.least("at", "low").alias("to"))
        lowest = materialize(lowest, "lowest")
        onward = lowest.select(F.col("at").alias("to"), F.col("to").alias("next"))
        moves = materialize(lowest.join(onward, "to").select("at", F.col("next").alias("to")), "moves")
        step = moves.select(F.col("at").alias("root"), F.col("to").alias("_to"))
        roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
        a, b = moves.toDF("a", "a2"), moves.toDF("b", "b2")
        moved = left.join(a, "a").join(b, "b").where("a2 <> b2")
        left = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    return roots
