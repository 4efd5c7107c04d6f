"""Connected components of a graph given as a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import cut


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours. Some rows may be repeated."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a < b")


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Links run from the larger b to the smaller a."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a > m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.union(least.select("b", F.col("m").alias("a"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node is either the centre of its links or the end of one alone."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("ends")).union(links.select(F.col("a").alias("node"), F.lit(0).alias("ends")))
    times = ends.groupBy("node").agg(F.sum("ends").alias("ends"), F.min("ends").alias("least"))
    return times.where("ends > least").isEmpty()


def components(links: DataFrame, rounds: int = 60, rows: int = 100_000) -> DataFrame:
    """(node, root) for every node that has a link: root is the least node of its component.

    links has a < b (any orderable type), without nulls or repeats. Rounds of large and small stars until each component is
    one star, about the logarithm of the longest chain; each keeps at most as many rows as it was given, aggregates before it
    shuffles, and joins on a node, which adaptive execution splits where one node has a large share. Each round is written
    to the shared folder, in as many parts as have about `rows` links each, so that few links leave few files. An empty table
    gives an empty table.
    """
    links = cut(links.select("a", "b"))
    parts = links.count() // rows + 1
    links = links.coalesce(parts)
    for _ in range(rounds):
        links = cut(_small(_large(links)).coalesce(parts))
        if _stars(links):
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
