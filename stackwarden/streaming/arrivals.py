"""The three jobs that run as files and moves arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.duplicates import with_quick_hash
from ..session import spread
from ..sources.stores import committed, remove

Trigger = dict  # arguments of DataStreamWriter.trigger, e.g. {"availableNow": True}


def suggest_on_arrival(
    stream: DataFrame, suggest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: Trigger | None = None,
) -> StreamingQuery:
    """Files each micro-batch with `suggest` and appends the suggestions. A batch that is run again
    overwrites its own output."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        suggest(spread(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


class BatchLog:
    """Rows by batch below one folder, in PARTS directories by key. A batch reads only the parts its keys fall in. Every
    COMPACT_EVERY batches the earlier ones are merged into one base, so the number of files stays bounded; a base counts
    once its commit marker is there, and a batch or a base that is written again overwrites itself."""

    PARTS = 16
    COMPACT_EVERY = 32

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.PARTS)).cast("int")

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.removeprefix(kind)) for n in committed(self.spark, self.path) if n.startswith(kind))

    def before(self, batch_id: int, like: DataFrame | None = None) -> DataFrame:
        """Rows of earlier batches; with `like`, only of the parts its keys fall in."""
        base = max((n for n in self._numbers("base-") if n <= batch_id), default=0)
        paths = [f"{self.path}/base-{base:012d}"] if base else []
        paths += [f"{self.path}/batch-{n:012d}" for n in self._numbers("batch-") if base <= n < batch_id]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        one = self.spark.read.schema(f"{self.schema}, part int")
        old = reduce(DataFrame.unionByName, [one.parquet(p) for p in paths])  # at most COMPACT_EVERY + 1
        if like is not None:
            old = old.filter(F.col("part").isin([r[0] for r in like.select(self.part()).distinct().collect()]))  # at most PARTS
        return old.drop("part")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows, f"batch-{batch_id:012d}")
        if batch_id and batch_id % self.COMPACT_EVERY == 0:
            self._write(self.before(batch_id), f"base-{batch_id:012d}")
            bases = [n for n in self._numbers("base-") if n <= batch_id][:-1]
            if bases:  # what the base before holds is held twice more
                remove(self.spark, [f"{self.path}/base-{n:012d}" for n in bases[:-1]]
                       + [f"{self.path}/batch-{n:012d}" for n in self._numbers("batch-") if n < bases[-1]])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")


def count_folders(moves: DataFrame, out: str, checkpoint: str, trigger: Trigger | None = None) -> StreamingQuery:
    """Running use count per folder. A move counts once however often and however late it is delivered: its id is looked
    up in a log of all moves, of which a batch reads the parts it needs. Every batch writes what it adds to the counters."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = BatchLog(spark, f"{out}/log", "move_id long, folder string", "move_id")
        new = batch.groupBy("move_id").agg(F.min("folder").alias("folder"))
        new.write.mode("overwrite").parquet(f"{out}/arrived/batch={batch_id}")
        new = spark.read.schema("move_id long, folder string").parquet(f"{out}/arrived/batch={batch_id}")
        log.put(new.join(log.before(batch_id, new).select("move_id"), "move_id", "left_anti"), batch_id)
        fresh = spark.read.schema("move_id long, folder string, part int").parquet(f"{out}/log/batch-{batch_id:012d}")
        fresh.groupBy("folder").agg(F.count(F.lit(1)).alias("used_count")).write.mode("overwrite").parquet(f"{out}/added/batch={batch_id}")

    w = moves.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def current_counts(spark, out: str) -> DataFrame:
    """The counter of each folder out of what `count_folders` wrote."""
    t = spark.read.option("basePath", f"{out}/added").parquet(f"{out}/added")
    return t.groupBy("folder").agg(F.sum("used_count").alias("used_count"))


def duplicates_on_arrival(
    stream: DataFrame, index: str, out: str, checkpoint: str, trigger: Trigger | None = None,
) -> StreamingQuery:
    """Checks arrivals (asset_id, path, size, content) against everything indexed before and each other.

    Appends (asset_id, first_id) for every arrival whose contents are known, and indexes the new ones. A batch reads the
    parts of the index that its hashes fall in. Output and index are written per batch, so a batch that is run again
    does no harm.
    """
    keys = ["quick_hash", "size", "digest"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = BatchLog(spark, index, "quick_hash string, size long, digest string, first_id long", "quick_hash")
        new = with_quick_hash(batch).select("asset_id", "path", *keys)
        new.write.mode("overwrite").parquet(f"{out}/arrived/batch={batch_id}")
        new = spark.read.parquet(f"{out}/arrived/batch={batch_id}")  # bytes are hashed once
        firsts = new.groupBy(*keys).agg(F.min("asset_id").alias("first_id"))
        old = known.before(batch_id, new).groupBy(*keys).agg(F.min("first_id").alias("known_id"))
        resolved = firsts.join(old, keys, "left").withColumn("origin", F.coalesce("known_id", "first_id"))
        new.join(resolved, keys).filter("asset_id <> origin").select(
            "asset_id", "path", F.col("origin").alias("first_id")).write.mode("overwrite").parquet(f"{out}/found/batch={batch_id}")
        known.put(resolved.filter("known_id IS NULL").select(*keys, "first_id"), batch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
