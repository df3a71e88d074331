"""Clusters as results: summaries, orders, edits. Member form: cluster_id, kind, asset_id, path, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, kind_of
from .leaders import elect
from .ranking import top_per_group

LOOSER_STEP = 0.05
LOOSEST = 0.65


def doc_threshold(image_threshold: float) -> float:
    """Texts are held to a slightly stricter threshold than pictures."""
    return min(0.97, image_threshold + 0.04)


def looser_threshold(threshold: float) -> float:
    """The next looser threshold; refuses where there is none."""
    new = max(LOOSEST, threshold - LOOSER_STEP)
    if new >= threshold:
        raise ValueError("the threshold is already the loosest one")
    return new


def recluster(vectors: DataFrame, scored_edges: DataFrame, floor: float, threshold: float) -> DataFrame:
    """(id, leader) at a looser or stricter threshold out of edges already computed down to `floor`."""
    if threshold < floor:
        raise ValueError("the edges were computed for a higher threshold; join the vectors again")
    return elect(vectors.select("id"), scored_edges.filter(F.col("sim") >= threshold).select("lo", "hi"))


def singles(assets: DataFrame, clustered: DataFrame) -> DataFrame:
    """Assets without a vector: one cluster each, of kind 'other'."""
    return assets.join(clustered.select("asset_id"), "asset_id", "left_anti").select(
        F.col("asset_id").alias("cluster_id"), F.lit("other").alias("kind"), "asset_id", "path", "size")


def first_kind(path) -> Column:
    k = kind_of(path)
    return F.when(k.isin("image", "video"), k).otherwise("other")


def cluster_summary(members: DataFrame) -> DataFrame:
    """Size, bytes and the kind of the first member of each cluster."""
    return members.groupBy("cluster_id", "kind").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("size").alias("total_bytes"),
        F.min_by(first_kind("path"), "asset_id").alias("first_kind"),
    )


def summary_order(by: str = "size") -> list:
    """The four result orders. Ties: pictures, texts, others, then the earlier cluster."""
    branch = F.when(F.col("kind") == "image", 0).when(F.col("kind") == "doc", 1).otherwise(2)
    size = F.col("n_items").desc()
    images = F.when(F.col("first_kind") == "image", 0).when(F.col("first_kind") == "video", 1).otherwise(2)
    videos = F.when(F.col("first_kind") == "video", 0).when(F.col("first_kind") == "image", 1).otherwise(2)
    lead = {"size": [size], "images_first": [images.asc(), size], "videos_first": [videos.asc(), size],
            "bytes": [F.col("total_bytes").desc()]}[by]
    return lead + [branch.asc(), F.col("cluster_id").asc()]


def previews(members: DataFrame) -> DataFrame:
    """Names of the first three members with the number left out, and the first six ids."""
    six = top_per_group(members, ["cluster_id"], [F.col("asset_id").asc()], 6, "pos")
    shown = six.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", file_name("path").alias("name"), "asset_id"))).alias("m"))
    counts = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_items"))
    names = F.array_join(F.transform(F.slice("m", 1, 3), lambda x: x["name"]), ", ")
    rest = F.when(F.col("n_items") > 3, F.concat(F.lit(", ... (+"), (F.col("n_items") - 3).cast("string"), F.lit(")")))
    ids = F.array_join(F.transform("m", lambda x: x["asset_id"].cast("string")), ",")
    return counts.join(shown, "cluster_id").select(
        "cluster_id", "n_items", F.concat(names, F.coalesce(rest, F.lit(""))).alias("preview"), ids.alias("first_ids"))


def eject(members: DataFrame, ejected: DataFrame) -> DataFrame:
    """Members taken out become clusters of their own; the rest keeps its cluster."""
    out = ejected.select("asset_id").distinct()
    kept = members.join(out, "asset_id", "left_anti")
    alone = members.join(out, "asset_id", "left_semi").withColumn("cluster_id", F.col("asset_id")).withColumn(
        "kind", F.when(kind_of("path") == "image", "image").otherwise("other"))
    # the leader may be among the ejected: the rest then goes under its first remaining member
    lead = kept.groupBy("cluster_id").agg(F.min("asset_id").alias("new_id"))
    kept = kept.join(lead, "cluster_id").withColumn("cluster_id", F.col("new_id")).drop("new_id")
    cols = ["cluster_id", "kind", "asset_id", "path", "size"]
    return kept.select(cols).unionByName(alone.select(cols))


def merge_singles(members: DataFrame, name: str = "Autres") -> DataFrame:
    """Assignment of all one-item clusters to one folder, if there are at least two of them."""
    ones = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("asset_id"), F.min("path").alias("path")).filter("n = 1")
    if len(ones.take(2)) < 2:
        ones = ones.limit(0)
    return ones.select("asset_id", "path", F.lit(name).alias("folder"))


def progress(members: DataFrame) -> DataFrame:
    """Clusters left, and how many of them hold one item."""
    sizes = members.groupBy("cluster_id").count()
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("count") == 1).alias("n_singles"))
