"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetscope.session import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, root) for every node of an edge that joins two different nodes; root is the component's smallest node.

    Each round maps every vertex to the smallest neighbour of its smallest neighbour and carries the edges along. An edge's
    image joins the images of its ends, so nothing falls apart; vertices only ever move to smaller ones, so the
    smallest stays. Edges whose ends meet go; when none is left, each component has one vertex. Rounds grow
    with the logarithm of the size. A hub's rows are reduced before the shuffle (min, distinct) or
    sit on the splittable side of an inner join. Null ends are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = checkpointed(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    moves = []
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        nearest = both.groupBy(F.col("e.a").alias("at")).agg(F.least(F.col("e.a"), F.min("e.b")).alias("to"))
        nearest = checkpointed(nearest.where("at <> to"))
        further = nearest.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        move = checkpointed(nearest.join(further, "to", "left").select("at", F.coalesce("beyond", "to").alias("to")))
        moves.append(move)
        for end in ("a", "b"):
            step = move.select(F.col("at").alias(end), F.col("to").alias("moved"))
            left = left.join(step, end, "left").withColumn(end, F.coalesce("moved", end)).drop("moved")
        left = left.where("a <> b")
        left = checkpointed(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = nodes.withColumn("root", F.col("node"))
    for move in moves:
        step = move.select(F.col("at").alias("root"), F.col("to").alias("moved"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("moved", "root").alias("root"))
    return checkpointed(roots) if moves else roots
