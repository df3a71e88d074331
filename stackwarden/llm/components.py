"""Connected components of a large graph by alternating large and small stars, checkpointed each round. A graph that is
counted to have few edges is settled in one task: each round's shuffles cost files for every partition, however few rows
there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Up to this many edges (16 bytes each) one task settles the graph.
EDGES_PER_TASK = 200_000


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not edges:
        return
    a, b = (np.concatenate(x) for x in zip(*edges))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = settle(len(nodes), at[:len(a)], at[len(a):])
    led = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[led]), pa.array(nodes[root[led]])], ["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges: a, b (long). Returns node, root (its component's smallest node) for each node of an edge that is not
    itself a root. Each round costs two joins; the number of rounds grows with the logarithm of the longest chain."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    if 0 < mark[0] <= edges_per_task:
        return cut_lineage(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"))
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
