"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmart.operators.shared_storage import materialize


def _digest(links: DataFrame) -> tuple[int, int]:
    """Number of links, and a sum that changes with any of them: one row for the driver."""
    row = links.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the least node around that node."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below it link to the least of them. Links lead from above to below."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` (a, b) except the roots.

    Each round is stored. It needs a number of rounds that grows with the logarithm of the graph; rows never number
    more than the links and twice that while a star is turned. Links of a node with itself count for nothing; an empty
    table gives an empty one.
    """
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    before = _digest(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)))
        after = _digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
