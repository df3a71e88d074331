"""Exact and near duplicate groups.

Members are kept in long form: group_id, kind, rep_hash, asset_id, path, size. A group's id is its
first asset id, so it does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.display import human_size
from ..session import cut_lineage
from .ranking import place_in_group

EXACT, NEAR = "exact", "quasi"


def with_quick_hash(assets: DataFrame) -> DataFrame:
    """Adds quick_hash and digest in the scan that reads the bytes, then lets go of the bytes: shuffles
    further down carry hashes only. What could not be read equals nothing and drops out here, by a test on
    the bytes; a test on the hashes would be pushed down to the scan and hash everything twice.

    Joins test their keys the same way, so cut the lineage before operators that join (all but `exact_groups`).
    Files that were hashed where they were listed (`sources.files.hashed`) come back as they are.
    """
    if {"quick_hash", "digest"} <= set(assets.columns):
        return assets.drop("content")
    return (
        assets.filter(F.col("content").isNotNull()).withColumn("quick_hash", H.quick_hash("content", "size"))
        .withColumn("digest", H.content_digest("content"))
        .drop("content")
    )


def exclude_paths(assets: DataFrame, gone: DataFrame) -> DataFrame:
    return assets.join(gone.select("path").distinct(), "path", "left_anti")


def hash_candidates(hashed: DataFrame) -> DataFrame:
    """Assets that share their quick hash with at least one other, with the size of the bucket. Counting
    combines map-side; the join back is an equi join that AQE splits where a bucket is skewed."""
    buckets = (
        hashed.groupBy("quick_hash").agg(F.count("quick_hash").alias("bucket_size"))
        .filter("bucket_size >= 2")
    )
    return hashed.join(buckets, "quick_hash")


def exact_groups(hashed: DataFrame) -> DataFrame:
    """One row per group of identical contents: rep_hash, size, digest, n_members, group_id."""
    return (
        hashed.groupBy(F.col("quick_hash").alias("rep_hash"), "size", "digest")
        .agg(F.count("digest").alias("n_members"), F.min("asset_id").alias("group_id"))
        .filter("n_members >= 2")
    )


def exact_members(hashed: DataFrame) -> DataFrame:
    g = exact_groups(hashed)
    return (
        hashed.withColumnRenamed("quick_hash", "rep_hash")
        .join(g, ["rep_hash", "size", "digest"])
        .select("group_id", F.lit(EXACT).alias("kind"), "rep_hash", "asset_id", "path", "size")
    )


def confirm_bytes(assets: DataFrame) -> DataFrame:
    """Groups whose contents are the same by a second, independent digest. Every group passes unless SHA-256 collides.
    Both digests are taken where the bytes are read; no bytes are grouped, sorted or shuffled."""
    hashed = assets.select("asset_id", "size", H.quick_hash("content", "size").alias("rep_hash"),
                           H.content_digest("content").alias("digest"), F.sha2("content", 512).alias("second"))
    return (
        hashed.groupBy("rep_hash", "size", "digest")
        .agg(F.count(F.lit(1)).alias("n_members"), F.min("asset_id").alias("group_id"),
             (F.min("second") == F.max("second")).alias("same_bytes"))
        .filter("n_members >= 2")
    )


def text_members(fingerprinted: DataFrame) -> DataFrame:
    """Assets grouped by equal text fingerprint: group_id, text_hash, asset_id, path, size.

    The fingerprints are written out first: they are small, and are needed twice, while the texts they
    come from are large and should be read once.
    """
    t = cut_lineage(fingerprinted.select("text_hash", "asset_id", "path", "size")).filter("text_hash IS NOT NULL")
    g = (
        t.groupBy("text_hash")
        .agg(F.count(F.lit(1)).alias("n_members"), F.min("asset_id").alias("group_id"))
        .filter("n_members >= 2").drop("n_members")
    )
    return t.join(g, "text_hash").select("group_id", "text_hash", "asset_id", "path", "size")


def near_groups(clusters: DataFrame, exact: DataFrame) -> DataFrame:
    """Clusters that say more than the exact groups do, in member form.

    Takes group_id, asset_id, path, size and a_hash or text_hash. Dropped are clusters of one, and
    clusters that lie wholly inside a single exact group. The label comes from the largest item.
    """
    c = clusters
    for col, typ in (("a_hash", "long"), ("text_hash", "string")):
        if col not in c.columns:
            c = c.withColumn(col, F.lit(None).cast(typ))
    known = exact.select("asset_id", F.col("group_id").alias("exact_id"))
    joined = c.join(known, "asset_id", "left").withColumn("exact_id", F.coalesce("exact_id", F.lit(-1)))
    kept = (
        joined.groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("exact_id").alias("lo"), F.max("exact_id").alias("hi"),
            F.min(F.struct((-F.col("size")).alias("s"), "asset_id", "a_hash", "text_hash")).alias("rep"),
        )
        .filter("n >= 2 AND NOT (lo = hi AND hi >= 0)")
        .select("group_id", F.col("rep.asset_id").alias("rep_id"), F.col("rep.a_hash").alias("rep_a_hash"),
                H.hash_label("rep.a_hash", "rep.text_hash").alias("rep_hash"))
    )
    return c.join(kept, "group_id").select(
        "group_id", F.lit(NEAR).alias("kind"), "rep_hash", "asset_id", "path", "size",
        "a_hash", "text_hash", "rep_id", "rep_a_hash",
    )


def match_percentages(members: DataFrame) -> DataFrame:
    """Likeness shown per near group: text groups 100, image groups by mean distance to the largest."""
    others = F.col("asset_id") != F.col("rep_id")
    dist = F.when(others, H.hamming("a_hash", "rep_a_hash"))
    return members.groupBy("group_id").agg(
        F.when(F.max(F.when(F.col("asset_id") == F.col("rep_id"), F.col("text_hash"))).isNotNull(), 100)
        .when(F.avg(dist).isNotNull(), H.match_percent(F.avg(dist)))
        .otherwise(95).alias("match_pct")
    )


def group_summary(members: DataFrame) -> DataFrame:
    """Size and recoverable bytes (all but the largest member) of each group."""
    return members.groupBy("group_id", "kind", "rep_hash").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum("size").alias("total_bytes"),
        (F.sum("size") - F.max("size")).alias("recoverable_bytes"),
    )


def summarise_exact(groups: DataFrame) -> DataFrame:
    """The same out of `exact_groups`: all members have one size, so nothing needs joining back."""
    return groups.select(
        "group_id", F.lit(EXACT).alias("kind"), "rep_hash", "n_members",
        (F.col("n_members") * F.col("size")).alias("total_bytes"),
        ((F.col("n_members") - 1) * F.col("size")).alias("recoverable_bytes"),
    )


def result_order() -> list:
    """Most recoverable first; exact before image before text groups where equal."""
    branch = F.when(F.col("kind") == EXACT, 0).when(~F.col("rep_hash").startswith("~txt:"), 1).otherwise(2)
    return [F.col("recoverable_bytes").desc(), branch.asc(), F.col("group_id").asc()]


def ranked_members(members: DataFrame, **kw) -> DataFrame:
    """Members with their rank by size in the group, largest first."""
    keys = ["group_id", "kind"]
    return place_in_group(members, keys, [F.col("size").desc(), F.col("asset_id").asc()], "rank_in_group", **kw)


def keepers(members: DataFrame) -> DataFrame:
    """The member kept per group: the largest, the first of equals."""
    best = F.min(F.struct((-F.col("size")).alias("s"), "asset_id"))
    return members.groupBy("group_id", "kind").agg(best.alias("b")).select(
        "group_id", "kind", F.col("b.asset_id").alias("keep_id"))


def all_but_largest(members: DataFrame) -> DataFrame:
    """What 'tick all but the largest' selects. Needs no ranking, only the keeper of each group."""
    return members.join(keepers(members), ["group_id", "kind"]).filter("asset_id <> keep_id").drop("keep_id")


def of_kind(groups: DataFrame, kind: str = "all") -> DataFrame:
    return groups if kind == "all" else groups.filter(F.col("kind") == kind)


def footer(summary: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Groups and recoverable bytes, or files and bytes of what is ticked."""
    if checked is None:
        agg = summary.agg(F.count(F.lit(1)).alias("n_items"),
                          F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias("bytes"))
    else:
        agg = checked.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return agg.withColumn("bytes_label", human_size("bytes"))
