"""Stores kept between runs: exemplars (versioned), folder usage and rules (append-only logs), caches."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators.filing import current_rules, folder_usage


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below root whose commit marker is there."""
    if not _exists(spark, root):
        return []
    fs, p = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [n for n in names if _exists(spark, f"{root}/{n}/_SUCCESS")]


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


class ExemplarStore:
    """Versions below one folder. A version counts once its commit marker is there, so a reader sees the
    old state or the new one, never a half-written one, on file systems without atomic renames too."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[str]:
        return [n for n in committed(self.spark, self.root) if n.startswith("v-")]

    def load(self) -> DataFrame:
        """The current vectors. Centroids are always computed from them, so they cannot be stale."""
        v = self.versions()
        if not v:
            return self.spark.createDataFrame([], S.EXEMPLARS)
        return S.conform(self.spark.read.schema(S.EXEMPLARS).parquet(f"{self.root}/{v[-1]}"), S.EXEMPLARS)

    def save(self, store: DataFrame) -> None:
        name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        S.conform(store, S.EXEMPLARS).write.partitionBy("modality").parquet(f"{self.root}/{name}")

    def drop_old(self, keep: int = 2) -> None:
        remove(self.spark, [f"{self.root}/{n}" for n in self.versions()[:-keep]])


class Log:
    """An append-only Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        S.conform(rows, self.schema).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


def usage_store(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, S.MOVE_LOG)


def rule_store(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, S.RULES)


def vector_cache(spark: SparkSession, path: str) -> Log:
    """Encoded vectors by file version; append what `plans.filing.enrich_missing` returns."""
    return Log(spark, path, S.VECTOR_CACHE)


def known_folders(log: Log) -> DataFrame:
    return folder_usage(log.read())


def learned_rules(log: Log) -> DataFrame:
    return current_rules(log.read())


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Groups, suggestions and plans as parquet, json or csv."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    w = df.write.mode(mode)
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)
