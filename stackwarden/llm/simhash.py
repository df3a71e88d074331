"""SimHash near-duplicates through tables of pivot distances.

A fingerprint's bit is set if it is set in over half of the text's shingle hashes. Fingerprints within RADIUS
differing bits are linked, and linked documents form components.

Distances to reference fingerprints are tabulated: two fingerprints within the radius differ by at most the radius in
every distance, so a pair with a larger coordinate difference is discarded and the rest is verified bit by bit. To
find the pairs at all, distances are also taken under masks. Each mask keeps half of the blocks that the bits are cut
into, and however the radius's bits are placed, some mask keeps none of them: there the two rows of masked distances
are equal. Rows are grouped by those, so no pair is missed. A crowded group is split by its free bits in the same way.
A group passes on a spanning set of its links only. Equal fingerprints are collapsed before all this.

Input: doc_id, text (null or wordless: fingerprint zero, linked like any other). Rows are independent; repeated rows
come back as they are. Rows without doc_id get their component's id too, null if no member has one. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path
from .common import hold, id_and_text, one_of_each, over_batches, whole_rows
from .components import components, settle

WORDS = 3
SEED = 42
RADIUS = 3
N_BLOCKS = 6
PIVOTS = 32
CROWD = 1024

BLOCKS = np.array([sum(1 << b for b in range(64 * i // N_BLOCKS, 64 * (i + 1) // N_BLOCKS)) for i in range(N_BLOCKS)], np.uint64)
MASKS = [np.bitwise_or.reduce(BLOCKS[list(c)]) for c in combinations(range(N_BLOCKS), N_BLOCKS - RADIUS)]
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)], np.uint64)


def fingerprint(text: str | None) -> int:
    """bytes.lower and bytes.split know ASCII letters and white space only, as the shingles want it."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - WORDS + 1))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        hold("simhash")

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

        return apply

    return over_batches(id_and_text(docs), make, "doc_id long, fp long")


def pivot_distances(fp: np.ndarray, mask: np.uint64 | None = None) -> np.ndarray:
    """Rows of distances to the references, under a mask if given."""
    x = fp[:, None] ^ REFERENCES[None, :]
    return np.bitwise_count(x if mask is None else x & mask)


def group_keys(fp: np.ndarray) -> np.ndarray:
    """For each mask, one number for the row of masked distances: masks x fingerprints."""
    weights = np.array([pow(6364136223846793005, i + 1, 1 << 64) for i in range(PIVOTS)], np.uint64)
    out = np.empty((len(MASKS), len(fp)), np.uint64)
    for i, mask in enumerate(MASKS):
        out[i] = (pivot_distances(fp, mask).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) * np.uint64(64) + np.uint64(i)
    return out


def close(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Which of the given pairs are within the radius: coordinates first, then the bits of what is left."""
    left = np.arange(len(a))
    for at in range(0, PIVOTS, 8):
        d = np.abs(da[left, at:at + 8].astype(np.int8) - db[left, at:at + 8].astype(np.int8)).max(axis=1)
        left = left[d <= RADIUS]
        if not len(left):
            break
    return left[np.bitwise_count(a[left] ^ b[left]) <= RADIUS]


def crowd_pairs(fp: np.ndarray, free: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius in a group of any size. Above CROWD, the bits that vary are cut into one part more
    than the radius; a close pair agrees on one of them."""
    m = len(fp)
    varying = int(np.bitwise_or.reduce(fp) & ~np.bitwise_and.reduce(fp))
    bits = [b for b in range(64) if varying >> b & 1]
    if m <= CROWD or len(bits) <= RADIUS:
        d = pivot_distances(fp)
        for at in range(0, m, 256):
            i, j = np.triu_indices(m - at, 1)
            i, j = i[i < 256] + at, j[i < 256] + at
            ok = close(fp[i], fp[j], d[i], d[j])
            if len(ok):
                yield i[ok], j[ok]
        return
    for part in range(RADIUS + 1):
        mask = np.uint64(sum(1 << b for b in bits[part::RADIUS + 1]))
        value = fp & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for sub in np.split(order, cuts):
            if len(sub) > 1:
                for i, j in crowd_pairs(fp[sub]):
                    yield sub[i], sub[j]


def links_of_groups(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within groups of equal keys; key is sorted."""
    n = len(fp)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [n]))
    size = np.diff(starts)
    # small groups together: each row meets the k-th row after it while that is in its group
    end = np.repeat(starts[1:], size)
    row = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    d = pivot_distances(fp)
    found_a, found_b = [], []
    k = 1
    while len(row := row[row + k < end[row]]):
        ok = close(fp[row], fp[row + k], d[row], d[row + k])
        found_a.append(row[ok])
        found_b.append(row[ok] + k)
        k += 1
    for g in np.flatnonzero(size > 64):
        at = starts[g]
        label = np.arange(size[g])
        for i, j in crowd_pairs(fp[at:at + size[g]]):
            label = settle(len(label), np.concatenate((i, np.arange(len(label)))), np.concatenate((j, label)))
        far = np.flatnonzero(label != np.arange(len(label)))
        found_a.append(far + at)
        found_b.append(label[far] + at)
    if not found_a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = settle(n, a, b)
    far = np.flatnonzero(label != np.arange(n))
    return fp[far], fp[label[far]]


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp. Pairs a, b that span all links within the radius."""

    def keyed():
        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = b.column(0).to_numpy().view(np.uint64)
            keys = group_keys(fp)
            return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(MASKS)))], ["k", "fp"])

        return apply

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp):
            a, b = links_of_groups(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= 1 << 16 and keys[-1][-1] != keys[0][0]:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                yield out(key[:cut], fp[:cut])
                keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield out(np.concatenate(keys), np.concatenate(fps))

    grouped = over_batches(distinct, keyed, "k long, fp long").repartition("k").sortWithinPartitions("k")
    return grouped.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row."""
    prints = cut_lineage(fingerprints(docs))
    known = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(known.select("fp")))
    placed = known.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, but one only of each component: its smallest doc_id. Of rows without doc_id, one more stays.
    Rows are written once with their fingerprint, so that each is told apart from others of its doc_id."""
    rows = whole_rows(docs).select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def make():
        hold("simhash")

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp)], ["row", "doc_id", "text_hash", "node"])

        return apply

    schema = rows.select("row", "doc_id", "text_hash").withColumn("node", F.lit(0).cast("long")).schema
    made = over_batches(rows, make, schema).withColumn("rid", F.monotonically_increasing_id())
    path = fresh_path(docs.sparkSession, "simhash")
    made.write.parquet(path)
    made = docs.sparkSession.read.schema(made.schema).parquet(path)
    return one_of_each(made, components(links(made.select(F.col("node").alias("fp")).distinct())))
