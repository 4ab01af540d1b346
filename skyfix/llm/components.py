"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_ROWS, HOT_SHARE, cut


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """edges (u, v) with the least neighbour m of u. Nodes with `hot` edges or more are few and their m is broadcast; the edges
    of the others are shuffled."""
    few = F.broadcast(least.where(F.col("c") >= hot).select("u", "m"))
    rest = least.where(F.col("c") < hot).select("u", "m")
    return edges.join(few, "u").unionByName(edges.join(few.select("u"), "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of the edges; label is the smallest node of its component. Each round is a written table.

    A node with very many edges is not one task's work: its edges stay spread over all tasks.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    hot = max(HOT_ROWS, -(-2 * now.count() // HOT_SHARE))
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least")
        large = _with_least(both, least, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "least")
        small = _with_least(large, least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")))
    return nodes.groupBy("node").agg(F.min("label").alias("label"))
