"""Group files that look or read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_document
from ..operators.clusters import cluster_summary, singles, summary_order
from ..operators.cosine import leader_clusters

IMAGE_THRESHOLD = 0.82
TEXT_THRESHOLD = 0.88


def cluster_assets(
    assets: DataFrame,
    vectors: DataFrame,
    image_threshold: float = IMAGE_THRESHOLD,
    text_threshold: float = TEXT_THRESHOLD,
    **kw,
) -> DataFrame:
    """Members (cluster_id, kind, asset_id, path, size) of all clusters of (asset_id, path, size, kind).

    Pictures and videos cluster together, documents apart; what has no vector stays alone.
    """
    v = assets.join(vectors.select("asset_id", "vec"), "asset_id")
    parts = []
    for kind, cond, threshold in (
        ("image", F.col("kind").isin("image", "video"), image_threshold),
        ("doc", is_document("kind"), text_threshold),
    ):
        mine = v.filter(cond)
        led = leader_clusters(mine.select(F.col("asset_id").alias("id"), "vec"), threshold, **kw)
        parts.append(mine.join(led.withColumnRenamed("id", "asset_id"), "asset_id").select(
            F.col("leader").alias("cluster_id"), F.lit(kind).alias("kind"), "asset_id", "path", "size"))
    clustered = parts[0].unionByName(parts[1])
    return clustered.unionByName(singles(assets, clustered))


def clusters_by_size(members: DataFrame, by: str = "size") -> DataFrame:
    return cluster_summary(members).orderBy(*summary_order(by))
