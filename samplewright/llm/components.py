"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

#: Links in one file between rounds.
FILE_LINKS = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of the component, itself included.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until nothing changes; the
    number of rounds follows the logarithm of the longest chain. Links are written out between rounds, so
    lost executors cost one round at most, and neither links nor components reach the driver.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, files = None, 1
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, files = state, 1 + state[0] // FILE_LINKS
        # A round never makes more links than it was given, and few links need few files.
        edges = store(_small_star(_large_star(edges)).coalesce(files), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct().coalesce(files))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Edges run from the larger node a to the smaller b, so the larger neighbours of u are the a of b = u.
    return edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()
