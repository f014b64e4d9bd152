"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or to the node itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    return larger.join(least, "u").select(F.col("v"), F.col("m").alias("u")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    own = least.select("v", F.col("m").alias("u"))
    return moved.union(own).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (node, root): every node that has a link, with the smallest node reachable from it.

    ``links`` has columns ``u`` and ``v``. Alternating large and small stars keep the number of links at most
    what it was and need a number of rounds that grows with the logarithm of the longest path. Each round is
    written to the shared folder. Nothing but a row count and a checksum reaches the driver. No rows give no rows.
    """
    ordered = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = stored(ordered, "links")
    mark = None
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)).select("u", "v"), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
