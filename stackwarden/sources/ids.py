"""Ids of paths that last: a dictionary of paths and labels that keeps the order of paths.

A path's id is a label with room on both sides. New paths get labels between those of their neighbours, so ids of old
paths stay, the order of ids is the order of paths, and a file that comes back has its old id. Paths that are gone keep
theirs. Where a gap is used up, all paths are labelled anew as the next epoch, and the dictionary tells old ids from new.

Paths are range-sorted; each slice hands on its first and last label (one row per slice), so no task sees all paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import kind_of
from ..operators.ranking import global_position, place_in_group, sorted_slices
from ..session import cut_lineage
from .stores import committed

LABELS = "path string, asset_id long"
LAST = (1 << 62)
STEP = 1 << 32


class PathIds:
    """A dictionary below one folder: epoch-N/part-... holds what each scan has added. A part counts once its commit
    marker is there. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, step: int = STEP):
        self.spark, self.root, self.step = spark, root.rstrip("/"), step

    def epoch(self) -> int:
        return max((int(n.removeprefix("epoch-")) for n in committed(self.spark, f"{self.root}/epochs")), default=0)

    def load(self, epoch: int | None = None) -> DataFrame:
        here = f"{self.root}/epoch-{self.epoch() if epoch is None else epoch:06d}"
        parts = [f"{here}/{n}" for n in committed(self.spark, here)]
        return self.spark.read.schema(LABELS).parquet(*parts) if parts else self.spark.createDataFrame([], LABELS)

    def _add(self, labels: DataFrame, epoch: int) -> None:
        labels.select("path", "asset_id").write.parquet(f"{self.root}/epoch-{epoch:06d}/part-{uuid.uuid4().hex}")

    def number(self, files: DataFrame) -> DataFrame:
        """Adds asset_id and kind to (path, ...), one row per path; what is new goes into the dictionary."""
        paths = cut_lineage(files.select("path").distinct())
        known = self.load()
        new = paths.join(known.select(F.col("path").alias("of")), F.col("path") == F.col("of"), "left_anti")
        if not new.isEmpty():
            labels = cut_lineage(between(known, new, self.step))
            if labels.filter("asset_id IS NULL").isEmpty():
                self._add(labels, self.epoch())
            else:
                self._relabel(known.select("path").unionByName(new.select("path")))
        return files.join(self.load(), "path").withColumn("kind", kind_of("path"))

    def _relabel(self, paths: DataFrame) -> None:
        paths = cut_lineage(paths)
        n, epoch = paths.count(), self.epoch() + 1
        step = max(1, min(self.step, LAST // (n + 1)))
        self._add(global_position(paths, [F.col("path").asc()], "at").select("path", ((F.col("at") + 1) * step).alias("asset_id")), epoch)
        # the epoch counts from here on
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/epochs/epoch-{epoch:06d}")

    def renamed(self, since: int) -> DataFrame:
        """asset_id, now: ids of an earlier epoch that are others today, for tables that hold them."""
        old = self.load(since).select("path", "asset_id")
        return old.join(self.load().select("path", F.col("asset_id").alias("now")), "path").filter("asset_id <> now").select("asset_id", "now")


def between(known: DataFrame, new: DataFrame, step: int = STEP) -> DataFrame:
    """path, asset_id of the new paths, evenly between the labels of the known paths around them; null where there is no
    room. known: path, asset_id in path order. new: path, none of them known."""
    rows = known.select("path", "asset_id").unionByName(new.select("path", F.lit(None).cast("long").alias("asset_id")))
    s = sorted_slices(rows, [F.col("path").asc()])
    slices = s.groupBy("_slice").agg(F.min("asset_id").alias("low"), F.max("asset_id").alias("high"))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    slices = slices.select(F.col("_slice").alias("of"), F.max("high").over(earlier).alias("before"), F.min("low").over(later).alias("after"))
    own = W.partitionBy("_slice").orderBy("_idx")
    s = s.withColumn("p", F.last("asset_id", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "n", F.first("asset_id", ignorenulls=True).over(own.rowsBetween(0, W.unboundedFollowing)))
    gaps = s.filter("asset_id IS NULL").join(slices, F.col("_slice") == F.col("of")).select(
        "path", F.coalesce("p", "before", F.lit(0)).alias("low"), F.coalesce("n", "after").alias("high"))
    gaps = cut_lineage(gaps)
    size = gaps.groupBy("low").agg(F.count(F.lit(1)).alias("size"), F.first("high").alias("to")).select(F.col("low").alias("of"), "size", "to")
    placed = place_in_group(gaps.select("path", "low"), ["low"], [F.col("path").asc()]).join(size, F.col("low") == F.col("of"))
    # behind the last known path there is room for steps of full size
    room = F.when(F.col("to").isNull(), F.least(F.lit(step), F.expr(f"({LAST} - low) div (size + 1)"))).otherwise(F.expr("(to - low) div (size + 1)"))
    return placed.select("path", F.when(room > 0, F.col("low") + room * F.col("place")).alias("asset_id"))
