"""Connected components by alternating large-star and small-star steps, each one a shuffle of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (its smallest reachable node) for every node of the undirected edges (a, b).

    Per round, each node sends its larger neighbours, then its smaller ones, to its smallest neighbour. The smallest
    neighbours are aggregated map-side and joined back, so a hub's edges needn't meet in one task. The number of edges
    never grows. Ends when a round changes nothing, which is found from the edges' count and hash sum; the steps converge
    for every graph. Null ends and loops are no edges.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: the larger neighbours v of u point to the smallest neighbour of u, or to u itself.
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        # Small star: of the smaller neighbours, all point to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        x = large.join(least, "u")
        small = least.select("u", F.col("m").alias("v")).union(x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(stars.select("comp", "comp").distinct())
