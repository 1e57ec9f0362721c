"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); a component is named by one of its nodes.

    Each round sends every node to its least neighbour and keeps what then still
    joins two nodes; stars vanish in a round or two, paths in a logarithmic number.
    All tables are distributed; the driver only asks whether any edge is left."""
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "moves")
        moves.append(move)
        ends = left.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        left = written(ends.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[-1].select("node", F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        later = found.withColumnRenamed("node", "to").withColumnRenamed("component", "later")
        found = move.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("component"))
    return found
