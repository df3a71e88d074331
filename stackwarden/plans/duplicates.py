"""Find duplicate files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import hamming_radius, is_document
from ..functions.text import text_fingerprint
from ..operators import duplicates as D
from ..operators.images import hash_clusters
from ..session import cut_lineage


def exact_duplicates(assets: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Groups of identical files by recoverable bytes: one shuffle of hashes, then the result's sort."""
    hashed = D.with_quick_hash(assets)
    if exclude is not None:  # after the bytes are gone, so that no join shuffles them
        hashed = D.exclude_paths(hashed, exclude)
    return D.summarise_exact(D.exact_groups(hashed)).orderBy(*D.result_order())


def duplicate_members(
    assets: DataFrame,
    near: bool = False,
    exclude: DataFrame | None = None,
    hashes: DataFrame | None = None,
    texts: DataFrame | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Members of all duplicate groups of (asset_id, path, size, kind, content).

    With near=True also pictures alike by perceptual hash (asset_id, a_hash) and documents of equal
    normalised text (asset_id, text).
    """
    hashed = D.with_quick_hash(assets).select("asset_id", "path", "size", "kind", "quick_hash", "digest")
    hashed = cut_lineage(hashed if exclude is None else D.exclude_paths(hashed, exclude))
    cols = ["group_id", "kind", "rep_hash", "asset_id", "path", "size"]
    exact = D.exact_members(hashed)
    if near:
        exact = cut_lineage(exact)
    out = exact.select(cols).withColumn("match_pct", F.lit(100))
    if not near:
        return out
    base = hashed.select("asset_id", "path", "size", "kind")
    branches = []
    if hashes is not None:
        pictures = base.filter("kind = 'image'").join(hashes.select("asset_id", "a_hash"), "asset_id")
        branches.append(hash_clusters(pictures.withColumn("radius", hamming_radius("path"))))
    if texts is not None:
        prints = texts.select("asset_id", text_fingerprint("text", max_chars).alias("text_hash"))
        branches.append(D.text_members(base.filter(is_document("kind")).join(prints, "asset_id")))
    for clusters in branches:
        members = cut_lineage(D.near_groups(clusters, exact))
        out = out.unionByName(members.join(D.match_percentages(members), "group_id").select(cols + ["match_pct"]))
    return out


def find_duplicates(assets: DataFrame, **kw) -> DataFrame:
    """All duplicate groups, most recoverable bytes first."""
    m = duplicate_members(assets, **kw)
    return m.groupBy("group_id", "kind", "rep_hash", "match_pct").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("size").alias("total_bytes"),
        (F.sum("size") - F.max("size")).alias("recoverable_bytes"),
    ).orderBy(*D.result_order())
