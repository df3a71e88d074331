"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of `min_chars` code points or
more that `min_docs` or more documents hold are repeated: their lines go, except in the largest doc_id that holds them.

Documents come in batches, largest doc_ids first. A batch's keys are hashed (128 bits), counted, and kept as a run: a
table bucketed and sorted by hash, with the number of documents and the largest doc_id for each. Before it is kept, the
batch is merge-anti-joined with the runs there are: what a run already knows to be repeated, with a doc_id at least as
large, is not kept again. As soon as a level has `fanout` runs they are merged into one run of the next level, so a hash
is rewritten once for each level, not once for each batch. As runs and batches are bucketed alike, joins and merges read
runs as they lie. When all batches are in, the runs are merged a last time, and lines look their verdict up in that run.

A key that holds many rows does not land in one task: counts combine map-side, and keys with over 1/HOT of all rows
(so at most HOT keys) are looked up by broadcast instead.

Input: doc_id, text (null or empty: one empty line). A null doc_id is smaller than any other; a key that only such rows
hold stays in all of them. Each row counts as a document, so equal rows keep and lose the same lines. Other columns,
whatever their names, come back untouched in the struct row. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path
from .common import hold, over_batches, whole_rows

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 6
FANOUT = 3
HOT = 1000


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """None for keys that are too short. bytes.strip and bytes.lower know ASCII only."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """The levelled runs: one table each of h, n (documents, counted up to being repeated) and last (largest doc_id)."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket is one sorted file, so a merge join needs no sort of a run
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        # without this, Spark 4.1 merges bucketed runs without a shuffle and leaves equal keys of two runs apart
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _keep(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select("h", "n", "last").write.option("path", f"{self.path.rstrip('/')}/{name}")
         .bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, batch: DataFrame) -> None:
        """batch: h, doc_id, one row for each hash of a document."""
        new = _counted(batch.select("h", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("last")))
        for name in self.names():
            known = self.spark.table(name).filter(F.col("n") >= self.min_docs).select(
                F.col("h").alias("of"), F.col("last").alias("upto"))
            new = new.join(known, (F.col("h") == F.col("of")) & (F.col("upto") >= F.col("last")), "left_anti")
        self._keep(new, 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self._merge(names, level + 1)
                self.levels[level] = []
                self._drop(names)

    def _merge(self, names: list[str], level: int) -> None:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        self._keep(_counted(rows), level)

    def compact(self) -> DataFrame:
        """All runs in one: h, n, last of every key."""
        names = self.names()
        if len(names) > 1:
            top = len(self.levels)
            self._merge(names, top)
            self.levels = [[] for _ in range(top)] + [self.levels[top]]
            self._drop(names)
        return self.spark.table(self.names()[0])

    def close(self) -> None:
        """Forgets the tables; their files stay until the shared folder is cleared."""
        self._drop(self.names())
        self.levels = []


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _batch_of(docs: DataFrame, batches: int):
    """Number of a row's batch, largest doc_ids first. Any cut gives the same result; even ones share the work."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.select("doc_id").stat.approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = F.lit(batches)
    for i, cut in enumerate(sorted(set(cuts))):
        batch = F.when(F.col("doc_id") > F.lit(int(cut)), batches - 1 - i).otherwise(batch)
    return batch


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """node, doc_id, h: each different key hash of a row. docs: node, doc_id, text."""

    def make():
        hold("linestore")

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            found: list[bytes] = []
            at: list[int] = []
            for i, text in enumerate(b.column(2).cast(pa.binary())):
                own = {key_hash(x, min_chars) for x in (text.as_py() or b"").split(b"\n")}
                own.discard(None)
                found.extend(own)
                at.extend([i] * len(own))
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(found, pa.binary())],
                                              ["node", "doc_id", "h"])

        return apply

    return over_batches(docs.select("node", "doc_id", "text"), make, "node long, doc_id long, h binary")


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """node, of_id, lost: the hashes whose lines go from the rows of that node and doc_id. docs: node, doc_id, text."""
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    rows = line_hashes(docs, min_chars).withColumn("batch", _batch_of(docs, batches))
    rows.write.partitionBy("batch").parquet(f"{path}/hashes")
    rows = spark.read.schema("node long, doc_id long, h binary, batch int").parquet(f"{path}/hashes")
    runs = LineRuns(spark, f"{path}/runs", min_docs, fanout)
    for batch in sorted(r.batch for r in rows.select("batch").distinct().collect()) or [0]:
        runs.add(rows.filter(F.col("batch") == batch))
    verdicts = runs.compact().filter(F.col("n") >= min_docs).select(F.col("h").alias("of"), "last")
    # at most HOT keys can hold over 1/HOT of all rows
    keys = cut_lineage(rows.groupBy("h").count().filter(F.col("count") > max(min_docs, rows.count() // HOT)).select(F.col("h").alias("hot")))
    gone = ~F.col("doc_id").eqNullSafe(F.col("last"))
    asked = rows.select("node", "doc_id", "h").join(F.broadcast(keys), F.col("h") == F.col("hot"), "left")
    cold = asked.filter("hot IS NULL").join(verdicts, F.col("h") == F.col("of")).filter(gone)
    known = F.broadcast(verdicts.join(F.broadcast(keys), F.col("of") == F.col("hot"), "left_semi"))
    warm = asked.filter("hot IS NOT NULL").join(known, F.col("h") == F.col("of")).filter(gone)
    return (cold.select("node", "doc_id", "h").union(warm.select("node", "doc_id", "h"))
            .groupBy("node", F.col("doc_id").alias("of_id")).agg(F.collect_set("h").alias("lost")))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """row (the input row), text (what stays; null stays null), n_lines, n_dropped of every row."""
    whole = whole_rows(docs).withColumn("node", F.xxhash64("doc_id", "text"))
    lost = lost_lines(whole.select("node", "doc_id", "text"), min_chars, min_docs, batches, fanout)
    met = whole.join(lost.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")

    def make():
        hold("linestore")

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            kept: list[bytes | None] = []
            n_lines, n_dropped = [], []
            for text, lost in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if lost:
                    lost = set(lost)
                    stay = [x for x in lines if key_hash(x, min_chars) not in lost]
                    n_dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(text)
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()).cast(pa.string(), safe=False), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["row", "text", "n_lines", "n_dropped"])

        return apply

    given = met.select("row", "text", "lost")
    schema = given.select("row", "text").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return over_batches(given, make, schema)


def drop_lines_sql() -> str:
    """The default parameters over documents."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = f"translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS MATERIALIZED (SELECT *, {key} AS key FROM l),
rep AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
j AS (SELECT k.*, rep.key IS NOT NULL AND k.doc_id IS DISTINCT FROM rep.last AS gone FROM k LEFT JOIN rep USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r"""
