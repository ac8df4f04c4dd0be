"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node of edges (u, v: long); the nodes of a component share its root.

    Ids should be spread at random (hashes). In each round a node goes to its smallest neighbour, or
    stays if it is smaller; edges are then those between the nodes gone to. The edges shrink
    geometrically, and so do the tables of moves, which are put together from the last round back to the
    first, so that a node is joined once for its round and not again in each later one. Tables are stored
    between rounds, and only whether edges are left reaches the driver. Joins are between stored tables, so
    that Spark can split a node with very many edges.
    """
    left = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    moves = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).select(F.col("u").alias("node"), "to"), "to")
        moves.append(to)
        of_u, of_v = to.toDF("u", "pu"), to.toDF("v", "pv")
        moved = left.join(of_u, "u").join(of_v, "v").where("pu <> pv")
        left = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if not moves:
        return left.toDF("node", "root")
    labels = moves.pop().toDF("node", "root")
    while moves:
        later = labels.toDF("to", "root")
        labels = stored(moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "labels")
    return labels
