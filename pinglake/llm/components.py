"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _minimum(edges: DataFrame) -> DataFrame:
    """Smallest of each node's neighbours and itself; counted before it is shuffled, so hot nodes are no burden."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes in ``edges`` (a, b: long); root is the smallest node reachable.

    A large star hangs each node's larger neighbours on the smallest one around, a small star the
    others; both keep components as they are, and they end with a star per component after about
    log(n) squared rounds. Every round is written to the shared folder, so lineage stays short and
    a lost executor costs one round at most.
    """
    now = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minimum(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Now a > b. The small star: all smaller neighbours of a node go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").union(small.select("a", "m")).toDF("b", "a").where("a != b").distinct()
        now = cut(small.select("a", "b"), "stars")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            # Unchanged by a round: each edge links a node to its component's smallest.
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state
