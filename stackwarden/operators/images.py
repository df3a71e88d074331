"""Clusters of perceptual hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hamming import radius_pairs
from .leaders import elect

BATCH_ROWS = 5_000  # so few codes cannot have more than 12.5 million pairs
PAIRS_PER_CODE = 32


def _codes(assets: DataFrame) -> DataFrame:
    """One row per distinct hash and radius, carrying its first asset id. Later copies always follow the
    first, so the joins see a solid-colour image once however many there are."""
    return assets.filter(F.col("a_hash").isNotNull()).groupBy(
        F.col("a_hash").alias("code"), "radius").agg(F.min("asset_id").alias("id"))


def hash_pairs(assets: DataFrame, **kw) -> DataFrame:
    """Pairs of distinct hashes within the later one's radius: lo, hi (first asset of each), distance."""
    return radius_pairs(cut_lineage(_codes(assets)), **kw)


def _lead(codes: DataFrame, batch_rows: int, pairs_per_code: int, **kw) -> DataFrame:
    """(id, leader) of (id, code, radius), in id order.

    Where near pairs are few, they are listed. Where they are many (a ball of codes all near one another, say), they are
    counted but not listed: ids go in batches, each twice as large as the one before. A batch meets the leaders there
    are, which lie apart from one another, and only what they do not cover is clustered in the same way.
    """
    n, pairs = codes.count(), radius_pairs(codes, **kw)
    if n <= batch_rows or pairs.count() <= pairs_per_code * n:
        return elect(codes, cut_lineage(pairs))
    shares, size = [], min(batch_rows, n // 2)
    while size < n:
        shares.append(size / n)
        size = 2 * size + batch_rows
    # any cut of the ids gives the same clusters, and no batch is the whole
    cuts = sorted({int(c) for c in codes.stat.approxQuantile("id", shares, 0.001)})
    leaders, settled = None, []
    for low, high in zip([None, *cuts], [*cuts, None]):
        rest = codes if low is None else codes.filter(F.col("id") > low)
        rest = rest if high is None else rest.filter(F.col("id") <= high)
        if leaders is not None:
            both = leaders.withColumn("leads", F.lit(True)).unionByName(rest.withColumn("leads", F.lit(False)))
            led = cut_lineage(radius_pairs(both, **kw).groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader")))
            settled.append(led)
            rest = cut_lineage(rest.join(led, "id", "left_anti"))
        chosen = cut_lineage(_lead(rest, batch_rows, pairs_per_code, **kw))
        settled.append(chosen)
        new = rest.join(chosen.filter("id = leader").select("id"), "id", "left_semi")
        leaders = cut_lineage(new if leaders is None else leaders.unionByName(new))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def hash_clusters(assets: DataFrame, batch_rows: int = BATCH_ROWS, pairs_per_code: int = PAIRS_PER_CODE, **kw) -> DataFrame:
    """Leader clusters of (asset_id, path, size, a_hash, radius): adds group_id, the leading asset."""
    codes = cut_lineage(_codes(assets))
    chosen = _lead(codes, batch_rows, pairs_per_code, **kw)
    lead = codes.join(chosen, "id").select(F.col("code").alias("a_hash"), "radius", F.col("leader").alias("group_id"))
    return assets.join(lead, ["a_hash", "radius"])
