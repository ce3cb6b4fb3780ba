"""Connected components of a graph of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossmill.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one around it."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.filter("b > a").join(least, "a").filter("b != least")
        .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node of its component, for every node but the roots.

    Each round is written to the shared folder, which cuts the lineage. A crowded node only ever costs a minimum and
    a join that adaptive execution can split; no list of neighbours is built.
    """
    links, last = stored(links.filter("a != b").distinct(), "links"), None
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
