"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_split, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of its component.

    Large-star and small-star steps in turn: every step replaces links so that each points to a smaller node,
    until all point to the smallest of their component. A step is one aggregation, combined before its
    exchange, and one join in which the links of a hot node stay where they are.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, total = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = staged(join_split(both.filter("b > a"), low, ["a"], "degree", total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        joined = join_split(large, low, ["a"], "degree", total)
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, edges = edges, staged(small.filter("a <> b").distinct(), "small_star")
        discard(before, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
