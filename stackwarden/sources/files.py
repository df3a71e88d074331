"""Files as tables: scans that list without reading, hashes of byte ranges, and whole reads of small files."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.paths import has_extension, kind_of, training_label, unify_separators
from ..operators.ranking import global_position
from ..session import cut_lineage
from . import folders as tree
from . import ranges

# Spark counts 4 MB for the opening of a file, so a slice of a listing holds some 32 files. So many slices make one task.
SLICES_PER_TASK = 64


def _binary(spark: SparkSession, folders: Iterable[str], recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        .load(list(folders))
    )


def _local(path) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def listing(spark: SparkSession, folders: Iterable[str], recursive: bool = True) -> DataFrame:
    """path, size, mtime of every file, hidden and empty ones too. Tasks list the folders and no bytes are read. Stores that
    only Spark knows are listed by Spark, which holds the list in the driver and leaves hidden and empty files out."""
    folders = list(folders)
    if all(map(tree.known, folders)):
        return tree.walk(spark, folders, recursive)
    listed = _binary(spark, folders, recursive).select(
        _local(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    slices = listed.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(slices / SLICES_PER_TASK))
    return listed.coalesce(tasks) if tasks < slices else listed


def contents(spark: SparkSession, folders: Iterable[str], recursive: bool = True,
             min_bytes: int = K.SCAN_MIN_BYTES) -> DataFrame:
    """path, size, mtime and bytes; files below the size are never opened. A row holds a whole file, which Spark limits to
    2 GiB; `hashed` has no such limit. A file that cannot be read is left out (`unreadable` lists these)."""
    folders = list(folders)
    if all(map(tree.known, folders)):
        return ranges.with_content(tree.walk(spark, folders, recursive).filter(F.col("size") >= min_bytes))
    return _binary(spark, folders, recursive).filter(F.col("length") >= min_bytes).select(
        _local(F.col("path")).alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"), "content")


def numbered(files: DataFrame) -> DataFrame:
    """Adds asset_id, the position in path order, and the kind. The ids give the total order that
    decides who leads a cluster and who comes first among equals."""
    return global_position(files, [F.col("path").asc()], "asset_id").withColumn("kind", kind_of("path"))


def hashed(spark: SparkSession, folders: Iterable[str], recursive: bool = True, min_bytes: int = K.SCAN_MIN_BYTES,
           block_bytes: int = ranges.BLOCK_BYTES, number: Callable[[DataFrame], DataFrame] = numbered) -> DataFrame:
    """asset_id, path, size, mtime, kind, quick_hash and digest of all files, of any size. Head and tail give the quick
    hash; contents are read, in blocks, of those files only that share theirs. The others have no digest. Ids are places
    in this listing, or, with `number=PathIds(...).number`, ids that later scans keep."""
    listed = listing(spark, folders, recursive).filter(F.col("size") >= min_bytes)
    quick = cut_lineage(ranges.with_quick_hash(listed).filter("quick_hash IS NOT NULL").drop("bytes_read"))
    shared = quick.groupBy("quick_hash", "size").count().filter("count >= 2").select("quick_hash", "size")
    asked = quick.join(shared, ["quick_hash", "size"], "left_semi").select("path", "size")
    digests = cut_lineage(ranges.content_digests(asked, block_bytes))
    return number(quick.join(digests, "path", "left"))


def unreadable(spark: SparkSession, folders: Iterable[str], read: DataFrame, recursive: bool = True,
               min_bytes: int = K.SCAN_MIN_BYTES) -> DataFrame:
    """Audit: listed files of min_bytes or more that are not among those read (path)."""
    listed = listing(spark, folders, recursive).filter(F.col("size") >= min_bytes)
    return listed.join(read.select("path").distinct(), "path", "left_anti")


def scan_for_duplicates(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Pictures, documents and videos of at least 1 KiB below the folders."""
    raw = _binary(spark, folders, True).filter(F.col("length") >= K.SCAN_MIN_BYTES)
    return raw.select(_local(F.col("path")).alias("path"), F.col("length").alias("size"),
                      F.col("modificationTime").alias("mtime")).filter(has_extension("path", K.SCAN_EXTS))


def scan_for_filing(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, [folder]).filter(has_extension("path", K.FILING_EXTS))


def scan_for_grouping(spark: SparkSession, folders: Iterable[str], files: Iterable[str] = (),
                      recursive: bool | Sequence[bool] = True) -> DataFrame:
    """Supported files of the folders, each listed flat or with all below it, plus files named one by one whatever their
    extension. A file reached twice counts once, under the first source."""
    folders, files = list(folders), list(files)
    deep = [recursive] * len(folders) if isinstance(recursive, bool) else list(recursive)
    parts = [listing(spark, [f], r).filter(has_extension("path", K.GROUPING_EXTS)) for f, r in zip(folders, deep, strict=True)]
    if files:
        parts.append(listing(spark, files, recursive=False))
    tagged = [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return first_of_path(out)


def first_of_path(files: DataFrame) -> DataFrame:
    """One row per path: the one of the smallest source_no."""
    cols = [c for c in files.columns if c not in ("path", "source_no")]
    best = F.min_by(F.struct(*cols, "source_no"), "source_no")
    return files.groupBy("path").agg(best.alias("b")).select("path", *[F.col(f"b.{c}").alias(c) for c in cols], "b.source_no")


def scan_training_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files of a sorted tree with their label, the directory relative to the root."""
    return with_training_label(listing(spark, [root]).filter(has_extension("path", K.FILING_EXTS)), root)


def with_training_label(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("label", training_label("path", root)).filter("label <> ''")


def first_level_folders(files: DataFrame, roots: Iterable[str]) -> DataFrame:
    """Distinct names of the folders right below the roots, hidden ones left out. Empty folders hold no
    file and so do not show."""
    names = []
    p = unify_separators("path")
    for root in roots:
        base = root.replace("\\", "/").rstrip("/") + "/"
        rest = F.when(p.startswith(base), F.split(F.substring(p, F.lit(len(base) + 1), F.length(p)), "/"))
        names.append(F.when((F.size(rest) > 1) & ~rest[0].startswith("."), rest[0]))
    n = files.select(F.explode(F.array(*names)).alias("folder"))
    return n.filter("folder IS NOT NULL AND folder <> ''").distinct()
