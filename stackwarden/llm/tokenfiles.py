"""Token ids as Parquet list columns, in ascending doc_id order.

Files hold doc_id, n_tokens and ids (array<int>). Each range of doc_ids is one sorted file, so file order and row
order are document order. Row groups and pages have set sizes, the column and offset indexes let a reader fetch the
pages of a few documents, and n_tokens can be read without the ids. Ids are dictionary-encoded; a page whose
dictionary grows too large falls back to delta packing (format version 2).

Input: doc_id, text (null: empty, one end id). A null doc_id sorts first. Rows with equal doc_id all stay, in the
order of their texts. An empty table gives an empty set of files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, id_and_text, over_batches
from .tokens import library_encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 1 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
                      row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> str:
    """Encodes and writes; returns the path. Texts are shuffled once, by ranges of doc_id."""
    tail = end_id.to_bytes(4, "little")

    def make():
        hold("tokens", library_encoder.cache_clear)
        encoder = library_encoder(tokenizer_path)

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x + tail for x in encoder.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "n_tokens", "ids"])

        return apply

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (over_batches(ordered, make, "doc_id long, n_tokens long, ids array<int>")
     .write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
     .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES)).option("parquet.enable.dictionary", "true")
     .option("parquet.writer.version", "v2").option("compression", "zstd").mode("errorifexists").parquet(path))
    return path


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns, with file name and row number: document order."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(
        *columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Adds start, the ids of all documents before: a running sum in each file, and one sum per file before it. The
    second window holds one row per file."""
    sums = read_token_files(spark, path, ("n_tokens",)).groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = F.sum("in_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("file").alias("of_file"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("within", F.coalesce(within, F.lit(0)))
            .join(sums, F.col("file") == F.col("of_file")).withColumn("start", F.col("before") + F.col("within"))
            .drop("within", "before", "of_file"))


def with_checksums(rows: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids: of all ids as little-endian unsigned 32-bit integers."""

    def make():
        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            crc, at = [], 0
            for end in (4 * ends).tolist():
                crc.append(zlib.crc32(flat[at:end]))
                at = end
            cols = [b.column(c) for c in ("doc_id", "n_tokens", "file", "row")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(crc, pa.int64())],
                                              ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

        return apply

    return over_batches(rows.select("doc_id", "n_tokens", "file", "row", "ids"), make,
                        "doc_id long, n_tokens long, file string, row long, ids_crc32 long")
