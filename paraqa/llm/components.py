"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node among its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "edges-least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for each node of the edges (a, b), both long.

    The joins are on all edges of a node against one row for it, from a table of its own, so that Spark can split a node of
    many edges. Each round
    is written to the shared folder; rounds end when a round changes nothing, after about the logarithm of the nodes.
    Edges with a null end or equal ends are no edges.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = staged(_small(staged(_large(now).distinct(), "edges-large")).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
