"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, looked_up, stored

def _with_least(links: DataFrame, total: int) -> DataFrame:
    """``u, v, m`` for links (u, v): m is the least v of u.  No task holds a hub's links: the grouping combines before it
    shuffles, and hubs are hot keys of the join."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return looked_up(links, least, ["u"], 2 * total)


def components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """``(node, component)`` for each node with a link; component is the smallest node that links reach.

    Null ends and links of a node with itself count for nothing; nodes may be of any type that has an order.  Each half of a
    round is written to the shared folder, so lineage stays short and lost executors cost one round.  Only hubs, counts and a
    checksum are collected.  Returns the table and its path."""
    spark = links.sparkSession
    u, v = F.col(a), F.col(b)
    edges = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges, path = stored(edges, "links")
    seen, total = None, edges.count()
    while total:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_at = stored(_with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "links")
        near = _with_least(large, total)
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after, to = stored(near.select(F.explode(pairs).alias("e")).select("e.*").where("u > v").distinct(), "links")
        # a sum of 40 bits of each hash can't overflow below 2^23 links a partition of sums; decimals hold the rest
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)"))).first()
        discard(spark, path, large_at)
        edges, path, total = after, to, now[0]
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct()), path
