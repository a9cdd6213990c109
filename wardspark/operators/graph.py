"""Clusters of linked rows by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.sources.files import kept

#: A node with more than 1 / HUBS of all link ends is a hub: there are fewer than HUBS, so their rows are broadcast and their links stay where they are.
HUBS = 1000


def _least(links: DataFrame) -> DataFrame:
    """links (u, v) with ``m``, the least of u and all its v.  Only nodes that are no hubs are shuffled with their links."""
    ends = kept(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    limit = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HUBS
    hubs = ends.filter((F.col("n") > limit) & (F.col("n") > 1000)).select("u", "m")
    marked = links.join(F.broadcast(hubs), "u", "left")
    return marked.filter("m is not null").union(marked.filter("m is null").drop("m").join(ends.select("u", "m"), "u").select("u", "v", "m"))


def _contracted(links: DataFrame) -> DataFrame:
    """links (u > v) after a large star (each v above u moves to the least neighbour of u) and a small star (each v below u, and u, move to the least of them)."""
    large = _least(kept(links.union(links.select("v", "u")))).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _least(kept(large.distinct()))
    moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): cluster is the least id that can be reached.  nodes: id; links: a, b.

    The number of rounds grows with the logarithm of a component, chains
    included.  Links are written after each round, in the folder that the cluster
    names in spark.checkpoint.dir; nothing is collected but a count and a checksum.
    """
    now = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, now = state, kept(_contracted(now))
    return nodes.select("id").join(now.select(F.col("u").alias("id"), F.col("v").alias("cluster")), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
