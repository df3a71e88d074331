"""Folders listed where tasks run, a level of the tree at a time, so no list of files is held by the driver or by a task.

A listing is everything there is, as the reference has it: hidden and empty files too, which Spark's own listing leaves
out. Links to folders are followed, but not to one they lie in. What is gone by the time it is looked at is left out;
a folder that may not be read is an error.

Paths without a scheme are local or mounted and are listed entry by entry; other schemes pyarrow knows give a folder's
entries at once, so there one folder has to fit a task. Schemes it does not know are left to Spark (`known` tells).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path

ROWS_PER_BATCH = 8192
SCHEMA = "path string, size long, mtime timestamp, folder boolean"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
Entry = tuple[str, int, int, bool]  # path, size, milliseconds, whether it is a folder


def local_path(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def known(path: str) -> bool:
    if "://" not in local_path(path):
        return True
    try:
        pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _leads_back(path: str) -> bool:
    real, above = os.path.realpath(path), os.path.dirname(path)
    while os.path.realpath(above) != real:
        if above == os.path.dirname(above):
            return False
        above = os.path.dirname(above)
    return True


def local_entries(folder: str) -> Iterator[Entry]:
    try:
        entries = os.scandir(folder)
    except (FileNotFoundError, NotADirectoryError):
        return
    with entries:
        for e in entries:
            try:
                s = e.stat()
            except OSError:  # gone, or a link to nothing
                continue
            path = os.fsencode(e.path).decode("utf-8", "replace")
            if stat.S_ISREG(s.st_mode):
                yield path, s.st_size, s.st_mtime_ns // 1_000_000, False
            elif stat.S_ISDIR(s.st_mode) and not (e.is_symlink() and _leads_back(e.path)):
                yield path, 0, 0, True


def store_entries(folder: str) -> Iterator[Entry]:
    fs, name = pafs.FileSystem.from_uri(quote(folder, safe=":/@"))
    before = folder.rstrip("/").removesuffix(name.rstrip("/"))
    for i in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
        if i.type == pafs.FileType.Directory:
            yield before + i.path, 0, 0, True
        elif i.type == pafs.FileType.File:
            yield before + i.path, i.size, (i.mtime_ns or 0) // 1_000_000, False


def _batch(rows: list[Entry]) -> pa.RecordBatch:
    path, size, ms, folder = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array([m * 1000 for m in ms], pa.timestamp("us", "UTC")), pa.array(folder, pa.bool_())],
        schema=_ARROW)


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[Entry] = []
    for b in batches:
        for folder in b.column(0).to_pylist():
            for e in store_entries(folder) if "://" in folder else local_entries(folder):
                rows.append(e)
                if len(rows) == ROWS_PER_BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _named(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[Entry]]:
    """The folders and the files among the paths, patterns expanded. What is not there is an error."""
    folders, files = [], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [fs.getFileStatus(p)] if fs.exists(p) else list(fs.globStatus(p) or [])
        if not found:
            raise FileNotFoundError(f"no such file or folder: {path}")
        for s in found:
            name = local_path(s.getPath().toString())
            if s.isDirectory():
                folders.append(name)
            else:
                files.append((name, s.getLen(), s.getModificationTime(), False))
    return folders, files


def walk(spark: SparkSession, paths: Iterable[str], recursive: bool) -> DataFrame:
    """path, size, mtime of each file: a snapshot, taken at once and spread evenly by path."""
    folders, files = _named(spark, dict.fromkeys(paths))
    tasks = 4 * spark.sparkContext.defaultParallelism
    kept = fresh_path(spark, "listing")
    levels = [f"{kept}/named"]
    spark.createDataFrame(_table(files), SCHEMA).write.parquet(levels[0])
    level = spark.createDataFrame(pa.table({"path": pa.array(folders, pa.string())}))
    more = bool(folders)
    while more:
        levels.append(f"{kept}/level-{len(levels)}")
        level.repartition(tasks, "path").mapInArrow(_entries_of, SCHEMA).repartition(tasks, "path").write.parquet(levels[-1])
        level = spark.read.schema(SCHEMA).parquet(levels[-1]).filter("folder").select("path")
        more = recursive and not level.isEmpty()
    return spark.read.schema(SCHEMA).parquet(*levels).filter("NOT folder").select("path", "size", "mtime")


def _table(files: list[Entry]) -> pa.Table:
    return pa.Table.from_batches([_batch(files)] if files else [], _ARROW)
