"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FEW, discard, spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any orderable type; gives node, root (the least node of its component) for all nodes but roots.

    Each step points neighbours at the least node around; edges stay as many as they were at most, no component is ever
    gathered in one place (a node with many neighbours is joined spread out), and the state of each step is a stored
    table that is deleted once the next one is there.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.groupBy("v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, size = seen, 2 * (seen[0] or 0)
        hot = (seen[2] or 0) > FEW
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("near"))
        large = spread_join(both, least, ["u"], "near", size, ["v"]) if hot else both.join(least, "u")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges") if hot else large
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("near"))
        small = (spread_join(large, low, ["u"], "near", size, ["v"]) if hot else large.join(low, "u")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, now = now, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(past, large)
