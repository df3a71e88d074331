"""Connected components of a large graph by alternating large and small stars, checkpointed each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root (its component's smallest node) for each node of an edge that is not
    itself a root. Each round costs two joins; the number of rounds grows with the logarithm of the longest chain."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    while mark[0]:
        # large star: larger neighbours go to the smallest neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        edges = cut_lineage(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
