"""Connected components of a link table, by alternating large-star and small-star steps.

The number of rounds grows with the logarithm of the longest path.  Every round
is two joins of the links with one row per node; nothing is collected but a
count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm._shared import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v.  Large: each neighbour above u moves to the least neighbour of u; small: those below."""
    both = links.select("u", "v").union(links.select("v", "u")) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = both.join(least, "u")
    if large:
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; links has two long columns a and b, component is the least node reachable."""
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        now = cut(_stars(_stars(now, True), False))
