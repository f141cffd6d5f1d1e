"""Connected components of a table of edges, by alternating large and small stars; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the least one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root): every node that occurs in an edge, with the least node reachable.

    Self-links, repeated edges and edges with a null end add nothing. An empty table gives an empty table.
    The stars are cut from their lineage by a table in the shared folder after each round.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        new = materialize(_small_star(_large_star(now)))
        new_n, same = new.count(), new.join(now, ["a", "b"], "left_anti").isEmpty()
        same = same and new_n == now.count()
        discard(new if same else now)
        if same:
            break
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
