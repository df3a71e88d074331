"""Leader clustering: an item joins the earliest leader it is near to, else it leads.

The leaders are the lexicographically first maximal independent set of the 'near' graph (edges lo < hi),
and an item's cluster is its smallest leader neighbour. Rounds: whoever has no smaller open neighbour
leads, its neighbours are covered, edges of covered items drop out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

# Up to this many open edges the rest is settled in one task.
EDGES_PER_TASK = 500_000
# After so many rounds what is still open is cut into connected components, each settled in a task of its own.
ROUNDS = 4


def _covered_in_order(batches):
    """Items that do not lead, given all edges of a bounded graph."""
    edges = pd.concat(list(batches), ignore_index=True)
    covered: set[int] = set()
    for lo, hi in edges.sort_values(["hi", "lo"]).itertuples(index=False):
        if lo not in covered:  # every edge into lo came before, as lo < hi
            covered.add(hi)
    yield pd.DataFrame({"id": pd.Series(sorted(covered), dtype="int64")})


def covered_items(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame | None:
    """Ids that have a leader among their smaller neighbours; None if there are no edges.

    Chains of near items (frames of a video, say) would take a round per link, so after ROUNDS rounds components of
    bounded size are settled side by side. Only a single component above the bound goes on in rounds."""
    open_edges = edges.select("lo", "hi")
    parts = []
    rounds = 0
    while True:
        n = open_edges.count()
        if n == 0:
            break
        if n <= edges_per_task:
            parts.append(open_edges.coalesce(1).mapInPandas(_covered_in_order, "id long"))
            break
        rounds += 1
        if rounds == ROUNDS:
            settled, open_edges = _settle_components(open_edges, edges_per_task)
            parts.append(settled)
            continue
        has_smaller = open_edges.select(F.col("hi").alias("lo")).distinct()
        led = open_edges.join(has_smaller, "lo", "left_anti").select(F.col("hi").alias("id")).distinct()
        led = cut_lineage(led)
        parts.append(led)
        open_edges = cut_lineage(
            open_edges.join(led.withColumnRenamed("id", "hi"), "hi", "left_anti")
            .join(led.withColumnRenamed("id", "lo"), "lo", "left_anti").select("lo", "hi")
        )
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _settle_components(edges: DataFrame, edges_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Covered ids of all components of at most edges_per_task edges, and the edges of larger ones."""
    roots = components(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    placed = cut_lineage(edges.join(roots, F.col("hi") == F.col("node")).select("lo", "hi", "root"))  # hi is never a root
    large = placed.groupBy("root").count().filter(F.col("count") > edges_per_task).select("root")
    small = placed.join(large, "root", "left_anti")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return next(_covered_in_order([group[["lo", "hi"]]]))

    return (cut_lineage(small.groupBy("root").applyInPandas(settle, "id long")),
            cut_lineage(placed.join(large, "root", "left_semi").select("lo", "hi")))


def elect(nodes: DataFrame, edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(id, leader) for every node. Edges (lo, hi) should be cut from their lineage by the caller."""
    covered = covered_items(edges, edges_per_task)
    if covered is None:
        return nodes.select("id", F.col("id").alias("leader"))
    to_leader = edges.join(covered.withColumnRenamed("id", "lo"), "lo", "left_anti")
    joined = to_leader.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader"))
    return nodes.select("id").join(joined, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
