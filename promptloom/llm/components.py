"""Connected components by alternating stars: every node ends linked to the smallest id of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node id reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest id it sees; links of a
    component of n nodes are a star after O(log^2 n) rounds. Minimums are combined before the shuffle, and the
    join side that holds them has one row per node, so that skew-join handling can split a hot node's other side.
    The driver sees a count and a checksum per round. Links to null or to itself are left out; empty in, empty out.
    """
    links = settled(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    )
    last = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settled(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    roots = links.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
