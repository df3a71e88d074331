"""What the operators of this package share: tables, settings and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, tune

# Rows handed to Python at once. Documents are long, so a batch stays a few megabytes.
BATCH_ROWS = 256
BATCH_BYTES = "16m"


_held: list = ["", None]


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called by tasks. A worker process serves one stage after another; what the operator before has cached in it is
    let go when another one starts, and the memory it has freed goes back to the system."""
    if _held[0] != owner:
        if _held[1] is not None:
            _held[1]()
        _held[:] = [owner, release]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc only
        if trim is not None:
            trim(0)


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, go no further."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the untouched row as a struct, so that no column of the row can clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose per-task set-up is made once by make() and then applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for b in batches:
            if b.num_rows:
                yield apply(b)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again. Spark then knows how large it is, and sends it to where large rows are
    if it is small, instead of shuffling those."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_of_each(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows: row, rid, doc_id, text_hash, node; roots: node, root (missing: itself). Of each component the row with the
    smallest doc_id stays, and one of those without doc_id. Rows are told apart by rid, so a doc_id that stands on
    texts of several components loses none of them."""
    placed = rows.select("rid", "doc_id", "text_hash", "node").join(
        roots.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select(
        "rid", "doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    stay = placed.groupBy("root", F.col("doc_id").isNull().alias("nameless")).agg(
        F.min(F.struct("doc_id", "text_hash", "rid")).alias("first")).select(F.col("first.rid").alias("stay"))
    gone = stored(placed.join(stay, F.col("rid") == F.col("stay"), "left_anti").select(F.col("rid").alias("gone")), "gone")
    return rows.join(gone, F.col("rid") == F.col("gone"), "left_anti").select("row.*")
