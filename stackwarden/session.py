"""Session settings, the shared work folder, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What a broadcast may hold at most; above it the operators take their shuffled form.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# What the operators rely on; all of it can be set on a running session. Joins back to a hot key are split
# by AQE, also where the split costs the next operator a shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_dirs: dict[str, str] = {}
_recorded: list[list[str]] = []


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "stackwarden", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on. A cluster's own settings win elsewhere."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # checkpoints go when nothing refers to them any more
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Named by spark.checkpoint.dir; a local run may fall back to /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return _local_dirs[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    return path


@contextmanager
def recorded_paths() -> Iterator[list[str]]:
    """The paths that fresh_path gives out inside, for a caller that knows when they are done with."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives lost executors and is not recomputed by later uses."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    # fresh column ids: the checkpoint would otherwise carry constraints over columns it no longer has
    return done.select([done[c].alias(c) for c in done.columns])


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer slices than cores (one small file of long texts, say), spread over the cores. A
    large table has many slices and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Counted, not guessed."""
    return df.count() <= max_rows
