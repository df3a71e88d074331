"""Near-duplicate texts by SimHash and the Jaccard resemblance of their word shingles.

Texts whose sets of `words`-word shingles overlap by `similarity` or more (shared / all) are linked, and linked texts
form components. Texts whose SimHashes differ by few bits are looked at first, and most families of copies end there.
Alone a SimHash of 64 bits is too coarse: at 0.8 two fingerprints differ by about ten bits, and by sixteen or more in
one of forty pairs. So for the rest each text has BANDS short fingerprints, each of ROWS smallest hashes; at
0.8 a pair shares none of them once in ten million. Found pairs are then checked on the shingles themselves.

Texts with equal sets are collapsed first. Groups of an equal fingerprint are mostly families of near copies: a few
rounds compare one member with all others, and only what then still lies in different components is compared pair by
pair. If these pairs are many (texts that share a passage and no more), the texts are first grouped anew by their rarest
shingles, as many of each as two that are alike cannot both do without; the rounds are then repeated on these groups.
Shingles are kept of those texts only that share a fingerprint with another.

Input: any columns, doc_id and text among them (null: no words). Rows are independent. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from . import simhash
from .common import hold, one_of_each, over_batches, stored, whole_rows
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
STARS = 4
PAIRS_PER_ROW = 8  # groups with more pairs than this are not compared pair by pair at once
SEED = 42

_rng = np.random.Generator(np.random.PCG64(SEED))
MULTIPLIERS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; a shorter text is one shingle, a wordless one has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of smallest hashes."""
    low = np.full(len(MIX), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[None, at:at + 2048] ^ MIX[:, None]) * MULTIPLIERS[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low)], np.uint64)


def _prepared(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, text_hash, node (hash of the set), size, fp (SimHash of the set), bands; written once, so that rid names a row."""
    rows = whole_rows(docs).select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def make():
        hold("resemblance")

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            node, size, fp, keys = [], [], [], []
            for t in b.column(3).to_pylist():
                h = shingles(t, words)
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                size.append(len(h))
                fp.append(simhash.majority(h))
                keys.append(band_keys(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()),
                 pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "text_hash", "node", "size", "fp", "bands"])

        return apply

    schema = rows.select("row", "doc_id", "text_hash").withColumns(
        {"node": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "fp": F.lit(0).cast("long"), "bands": F.array().cast("array<long>")}).schema
    made = over_batches(rows, make, schema).withColumn("rid", F.monotonically_increasing_id())
    path = fresh_path(docs.sparkSession, "resemblance")
    made.write.parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _sets(nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """node, h: the shingles of the given nodes, cut from one text of each."""
    first = rows.groupBy("node").agg(F.min("rid").alias("first")).join(nodes.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi")
    first = stored(first.select("first"), "texts")
    texts = rows.select("rid", "node", F.col("row.text").cast("string").alias("text")).join(first, F.col("rid") == F.col("first"), "left_semi").select("node", "text")

    def make():
        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            h = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["node", "h"])

        return apply

    return stored(over_batches(texts, make, "node long, h array<long>"), "shingles")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingles overlap enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
            .select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).cast("long").alias("n")))
    return both.filter(1000 * F.col("n") >= round(1000 * similarity) * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _close_prints(rows: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that span all links between SimHashes within the radius."""
    prints = stored(rows.filter("size > 0").groupBy("node").agg(F.first("fp").alias("fp")), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    equal = prints.join(firsts, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = stored(simhash.links(firsts.select("fp")).distinct(), "links")
    ends = [firsts.select(F.col("fp").alias(f"{c}_fp"), F.col("first").alias(f"{c}_first")) for c in "ab"]
    across = links.join(ends[0], F.col("a") == F.col("a_fp")).join(ends[1], F.col("b") == F.col("b_fp"))
    return equal.union(across.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """k, node, size, room: the given nodes under their rarest shingles k, and how many of a node's shingles are not rarer
    than k. A set of n that is alike to another shares at least similarity * n with it, so one of any n - similarity * n + 1
    that are the first in an order that all sets keep to. Under the first one they share, they share the rooms at most."""
    of = nodes.select(F.col("node").alias("of"))
    each = sets.join(of, F.col("node") == F.col("of"), "left_semi").select("node", F.size("h").alias("size"), F.explode("h").alias("k"))
    n = each.groupBy(F.col("k").alias("shingle")).agg(F.count("*").alias("m"))
    shared = F.floor((F.col("size") * round(1000 * similarity) + 999) / 1000)
    at = F.row_number().over(Window.partitionBy("node").orderBy("m", "k"))  # a text's own shingles
    ranked = each.join(n, F.col("k") == F.col("shingle")).withColumn("at", at)
    return stored(ranked.filter(F.col("at") <= F.col("size") - shared + 1).filter("m > 1").select(
        "k", "node", F.col("size").cast("long").alias("size"), (F.col("size") - F.col("at") + 1).cast("long").alias("room")), "rare")


def _crowded(groups: DataFrame) -> bool:
    """Whether the groups k have many pairs."""
    m = groups.groupBy("k").agg(F.count("*").alias("m"))
    rows, pairs = m.agg(F.sum("m"), F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()
    return pairs > PAIRS_PER_ROW * rows


def roots_of(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node, root for each node of a component that is not itself its root."""
    each = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    bands = each.select(F.explode("bands").alias("k"), "node", "size", F.col("size").alias("room"))
    n = bands.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("k").alias("of"))
    open_groups = stored(bands.join(n, F.col("k") == F.col("of"), "left_semi"), "bands")
    sets = _sets(stored(open_groups.select("node").distinct(), "nodes"), rows, words)
    part = round(1000 * similarity)
    near = F.least("room", "room_b") * (1000 + part) >= part * (F.col("size") + F.col("size_b"))  # of what is shared at most

    def meet(left: DataFrame, right: DataFrame, on) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
        return left.join(r, F.col("k") == F.col("k_b")).filter(near & on).select(F.col("node").alias("a"), F.col("node_b").alias("b"))

    found = stored(_alike(_close_prints(rows), sets, similarity), "alike")
    roots, turn, rare = None, 0, False
    while True:
        if roots is None:
            roots = stored(components(found), "roots")
        placed = open_groups.join(roots.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select(
            "k", "node", "size", "room", F.coalesce("root", "node").alias("root"))
        split = placed.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(F.col("k").alias("of"))
        placed = stored(placed.join(split, F.col("k") == F.col("of"), "left_semi"), "open")
        if placed.isEmpty():
            return roots
        if turn == STARS and not rare and _crowded(placed):
            open_groups = _by_rare_shingles(placed.select("node").distinct(), sets, similarity)
            turn, rare = 0, True
            continue
        if turn < STARS:
            pivot = placed.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "size", "room", "root")).alias("p")).select(
                "k", "p.node", "p.size", "p.room", "p.root")
            asked = meet(placed, pivot, F.col("root") != F.col("root_b"))
        else:
            asked = meet(placed, placed, F.col("root") < F.col("root_b"))
        found = stored(found.union(_alike(asked, sets, similarity)), "alike")
        if turn == STARS:
            return components(found)
        open_groups, roots, turn = placed.select("k", "node", "size", "room"), None, turn + 1


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, but one only of each component: its smallest doc_id. Of rows without doc_id, one more stays."""
    rows = _prepared(docs, words)
    return one_of_each(rows, roots_of(rows, words, similarity))
