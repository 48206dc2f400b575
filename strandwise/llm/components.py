"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_join


def _least(edges: DataFrame, n: int) -> DataFrame:
    """Each edge of ``edges`` (a, b) with the least neighbour ``m`` of its ``a``; ``n`` bounds the edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    return split_join(edges, least, "a", "_n", n)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smaller of the node and its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (edges run downwards)."""
    moved = _least(edges, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(edges.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node with a link to another, the smallest node reachable.

    Self links and repeated links are ignored; an empty table gives an empty result.  The minimum of a
    node's neighbours is a plain aggregate (combined before the shuffle).  Hubs, the at most some hundred
    nodes that hold more than a fixed share of all links, are joined by a broadcast of their minima, so their
    links stay where they are and no task gathers them.  Each round is written to the shared folder; nothing
    is collected but two totals a round.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "links")
    n, seen = now.count(), None
    for _ in range(max_rounds if n else 0):
        now = cut(_large_star(now, n).filter("a > b").distinct(), "stars")
        now = cut(_small_star(now, now.count()).filter("a > b").distinct(), "stars")
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if total == seen:
            break
        n, seen = total["n"], total
    else:
        if n:
            raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
