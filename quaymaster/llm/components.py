"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaymaster.llm.common import written

MOST_ROUNDS = 64


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select("b", "a"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the smallest of the node and its neighbours."""
    ways = _both_ways(links)
    least = ways.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a"), F.least("a", "least").alias("least"))
    return ways.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); the component is its smallest node.

    Repeated links, links both ways and links to oneself are allowed. Rounds are written
    tables; what reaches the driver is one fingerprint of all links a round. Raises if the
    links still change in the last of ``MOST_ROUNDS`` rounds.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    before = None
    for _ in range(MOST_ROUNDS):
        links = written(_small_star(_large_star(links).distinct()).distinct(), "stars")
        state = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
