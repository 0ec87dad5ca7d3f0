"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, let_go


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, any comparable type -> node, comp: the least node reachable.

    Alternating large-star and small-star rounds: every round is two grouped
    minima, hubs only ever hold their minimum, and the number of rounds grows
    with the logarithm of the longest chain.  Each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, to the least one
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(small.where("a <> b").distinct(), "components")
        if before is not None:
            let_go(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        stars = edges.select("a").intersect(edges.select("b")).isEmpty()
        if (stars and state[0] == state[2]) or tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = tuple(state)
