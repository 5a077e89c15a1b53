"""Connected components by alternating star steps, each a grouping and a join, written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgrain.session import cut_lineage

#: Edges of a partition.
PART_EDGES = 250_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); the component is its smallest id.

    Large star: neighbours above a node are hung on the least node it knows. Small star: a node and its lower neighbours are
    hung on the least of them. Both together halve paths, so rounds grow with the logarithm of the longest path. A node of
    any degree is one row in the partial minimum, and its edges may be split in the join. A step never has more edges than the
    first, so its partitions follow their number; else each step of a small graph writes as many files as shuffles have partitions.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = 1 + e.count() // PART_EDGES
    e = e.coalesce(parts)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut_lineage(large.coalesce(parts).distinct().coalesce(parts))
        least = _least(large).coalesce(parts)
        lower = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(lower.coalesce(parts).unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().coalesce(parts))
