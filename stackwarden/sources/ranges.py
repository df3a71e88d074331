"""Byte ranges of files of any size, read and hashed where a task runs.

A listing (path, size) turns into rows of ranges; tasks seek to their ranges and return digests, so no content is ever a
value of a row. The quick hash reads the head and the tail of a file. Contents are compared by a tree digest: SHA-256 of
each block, and of the list of these where there is more than one. The blocks of a huge file are spread over tasks.

A file that cannot be opened, or is shorter than it was listed, has null digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K

BLOCK_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
# Rows handed to a task's reader at once; each stands for a file or a block, so few of them are much work
RANGES_PER_BATCH = 64


def open_input(path: str) -> BinaryIO:
    """A seekable stream. Paths without a scheme are local or mounted; others go by what the scheme stands for."""
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(name)


def read_range(f: BinaryIO, offset: int, length: int) -> Iterator[bytes]:
    """The pieces of a range. Raises EOFError where the file ends before the range does."""
    f.seek(offset)
    while length > 0:
        piece = f.read(min(PIECE_BYTES, length))
        if not piece:
            raise EOFError("the file is shorter than it was listed")
        length -= len(piece)
        yield piece


def quick_digest(path: str, size: int) -> tuple[str | None, int]:
    """SHA-256 over the first and last 16 KiB (or all of a small file) and the size; and the bytes read."""
    k, h, n = K.HEAD_TAIL_BYTES, hashlib.sha256(), 0
    try:
        with open_input(path) as f:
            for offset, length in [(0, size)] if size <= 2 * k else [(0, k), (size - k, k)]:
                for piece in read_range(f, offset, length):
                    h.update(piece)
                    n += len(piece)
    except (OSError, EOFError):
        return None, n
    h.update(b"|%d" % size)
    return h.hexdigest(), n


def block_digest(path: str, offset: int, length: int) -> bytes | None:
    h = hashlib.sha256()
    try:
        with open_input(path) as f:
            for piece in read_range(f, offset, length):
                h.update(piece)
    except (OSError, EOFError):
        return None
    return h.digest()


def with_quick_hash(files: DataFrame) -> DataFrame:
    """Adds quick_hash and bytes_read to (path, size, ...): 32 KiB at most of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = b.column("path").to_pylist(), b.column("size").to_pylist()
            for at in range(0, b.num_rows, RANGES_PER_BATCH):
                part = b.slice(at, RANGES_PER_BATCH)
                got = [quick_digest(p, n) for p, n in zip(paths[at:at + RANGES_PER_BATCH], sizes[at:at + RANGES_PER_BATCH])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([q for q, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())],
                                                 [*part.schema.names, "quick_hash", "bytes_read"])

    schema = files.withColumns({"quick_hash": F.lit(None).cast("string"), "bytes_read": F.lit(None).cast("long")}).schema
    return files.mapInArrow(run, schema)


def with_content(files: DataFrame) -> DataFrame:
    """Adds the content to (path, size, ...), a file at a time. Files that cannot be read, or are shorter than listed, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (path, size) in enumerate(zip(b.column("path").to_pylist(), b.column("size").to_pylist())):
                try:
                    with open_input(path) as f:
                        content = b"".join(read_range(f, 0, size))
                except (OSError, EOFError):
                    continue
                yield pa.RecordBatch.from_arrays([*b.slice(at, 1).columns, pa.array([content], pa.binary())], [*b.schema.names, "content"])

    return files.mapInArrow(run, files.withColumn("content", F.lit(b"")).schema)


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, size, block, start, length: a row for each block of each file."""
    last = F.greatest(F.ceil(F.col("size") / block_bytes) - 1, F.lit(0)).cast("long")
    b = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    start = F.col("block") * block_bytes
    return b.withColumn("start", start).withColumn("length", F.least(F.lit(block_bytes), F.col("size") - start))


def content_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, digest of (path, size), read in blocks. A file with an unreadable block is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, RANGES_PER_BATCH):
                part = b.slice(at, RANGES_PER_BATCH)
                d = [block_digest(*r) for r in zip(*(part.column(c).to_pylist() for c in ("path", "start", "length")))]
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("block"), pa.array(d, pa.binary())], ["path", "block", "digest"])

    # neighbouring blocks of one file would otherwise sit in the task that listed it
    spread = blocks(files, block_bytes).repartition("path", "block")
    done = spread.mapInArrow(run, "path string, block long, digest binary").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count("digest").alias("n_read"), F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("l"))
    tree = F.sha2(F.aggregate(F.col("l.digest"), F.lit(b""), lambda a, x: F.concat(a, x)), 256)
    whole = F.lower(F.hex(F.col("l.digest")[0]))
    return done.filter("n = n_read").select("path", F.when(F.col("n") == 1, whole).otherwise(tree).alias("digest"))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes content to the file path (relative) below root, for each row of (path, content); returns path and size. A
    file is written under a name of its own and then moved, so a task that runs again leaves whole files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "://" in root:
            fs, base = pafs.FileSystem.from_uri(quote(root, safe=":/@"))
        else:
            fs, base = pafs.LocalFileSystem(), root.removeprefix("file:")
        made = set()
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                name = f"{base.rstrip('/')}/{path.as_py().lstrip('/')}"
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content.as_py() or b"")
                fs.move(part, name)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64())], ["path", "size"])

    return rows.select("path", "content").mapInArrow(run, "path string, size long")
