"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(both: DataFrame) -> DataFrame:
    """a, b and the least of a's neighbourhood, from links listed in both directions."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["a2"]).select("a", "b", "m")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the least node of its component) of every node with a link a, b.

    Large stars hang every greater neighbour on the least of a node's
    neighbourhood, small stars every lesser one; turn about until nothing
    changes, in a number of rounds that grows with the logarithm of the
    longest path. Minima combine before they are shuffled, and a round's links
    are never more than the last one's. A round's links are written to the
    shared folder and those before them removed.
    """
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        last = tuple(mark)
        both = edges.union(edges.select("b", "a"))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"), "m")
        small = large.join(least, large["a"] == least["a2"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("a2"), "m")).distinct()
        new = scratch.cut(small)
        scratch.drop(edges)
        edges = new
