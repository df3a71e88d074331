"""All pairs of 64-bit codes within a Hamming radius, exactly, as equi joins.

Codes within distance r agree on at least one of r + 1 disjoint bit ranges (or on n - r of n ranges), so
joining on masked codes misses no pair. Where a masked value is common, its bucket is split again over
the bits not yet fixed, by the same argument, until the bucket is small. Distinct codes bound the last
bucket by 2^(free bits), so no bucket stays large whatever the data look like.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..session import cut_lineage

MAX_RADIUS = 3
MAX_BUCKET = 4096
WIDE_KEYS_FROM = 1_000_000
_STOP_AT_FREE_BITS = 11


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ranges(bits: list[int], parts: int) -> list[int]:
    """Masks that split the given bit positions into equal runs."""
    base, extra = divmod(len(bits), parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i < extra)
        out.append(sum(1 << b for b in bits[at:at + n]))
        at += n
    return out


@dataclass(frozen=True)
class Mask:
    """A set of bits codes must agree on. A pair counts here only if it agrees on no earlier mask, so
    that it comes out once and needs no later distinct."""

    bits: int
    earlier: tuple[int, ...]

    @property
    def free(self) -> list[int]:
        return [b for b in range(64) if not self.bits >> b & 1]

    def split(self) -> list["Mask"]:
        parts = [self.bits | m for m in _ranges(self.free, MAX_RADIUS + 1)]
        return [Mask(p, self.earlier + tuple(parts[:i])) for i, p in enumerate(parts)]


def first_masks(n_codes: int) -> list[Mask]:
    """Four keys of 16 bits for up to a million codes, twenty keys of about 32 bits beyond."""
    if n_codes <= WIDE_KEYS_FROM:
        sets = _ranges(list(range(64)), MAX_RADIUS + 1)
    else:
        sets = [sum(c) for c in combinations(_ranges(list(range(64)), 6), 6 - MAX_RADIUS)]
    return [Mask(m, tuple(sets[:i])) for i, m in enumerate(sets)]


def _keyed(codes: DataFrame, masks: dict[int, Mask]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("code").bitwiseAND(F.lit(_signed(m.bits))).alias("part"))
                     for k, m in masks.items()])
    return codes.select("id", "code", "radius", "leads", F.explode(keys).alias("k")).select("id", "code", "radius", "leads", "k.*")


def radius_pairs(codes: DataFrame, max_bucket: int = MAX_BUCKET, wide_from: int = WIDE_KEYS_FROM) -> DataFrame:
    """Pairs lo < hi of (id, code, radius) whose distance is within the radius of hi. With a column leads, lo is one
    that leads and hi one that does not.

    Codes should be distinct per radius; equal ones are collapsed by the caller.
    """
    bipartite = "leads" in codes.columns
    codes = codes.select("id", "code", "radius", "leads" if bipartite else F.lit(False).alias("leads"))
    n = codes.count()
    first = first_masks(n if wide_from == WIDE_KEYS_FROM else (WIDE_KEYS_FROM + 1 if n > wide_from else n))
    masks = dict(enumerate(first))
    level = masks
    keyed = _keyed(codes, level)
    done = []
    while True:
        sizes = keyed.groupBy("mask", "part").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= max_bucket:
            done.append(keyed)
            break
        crowded = sizes.filter((F.col("count") > max_bucket)
                               & F.col("mask").isin([k for k, m in level.items() if len(m.free) > _STOP_AT_FREE_BITS]))
        crowded = cut_lineage(crowded.select("mask", "part"))
        hot = sorted(r[0] for r in crowded.select("mask").distinct().collect())  # at most one per mask
        if not hot:
            done.append(keyed)
            break
        done.append(keyed.join(crowded, ["mask", "part"], "left_anti"))
        children, level = [], {}
        for k in hot:
            ids = range(len(masks), len(masks) + MAX_RADIUS + 1)
            for c, m in zip(ids, masks[k].split()):
                masks[c] = level[c] = m
                children.append((k, c, _signed(m.bits)))
        # at most four rows per mask
        split = F.broadcast(codes.sparkSession.createDataFrame(children, "mask int, child int, bits long"))
        again = keyed.join(crowded, ["mask", "part"], "left_semi").join(split, "mask")
        keyed = cut_lineage(again.select("id", "code", "radius", "leads", F.col("child").alias("mask"),
                                         F.col("code").bitwiseAND(F.col("bits")).alias("part")))
    keyed = done[0]
    for d in done[1:]:
        keyed = keyed.unionByName(d)

    a, b = (keyed.filter("leads"), keyed.filter("NOT leads")) if bipartite else (keyed, keyed)
    a, b = a.alias("a"), b.alias("b")
    diff = F.col("a.code").bitwiseXOR(F.col("b.code"))
    pairs = a.join(
        b,
        (F.col("a.mask") == F.col("b.mask")) & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.id") < F.col("b.id")) & (hamming("a.code", "b.code") <= F.col("b.radius")),
    )
    # of the pairs found, keep each under the first mask it agrees on; one row per mask
    earlier = F.broadcast(codes.sparkSession.createDataFrame(
        [(k, [_signed(e) for e in m.earlier]) for k, m in masks.items()], "mask int, earlier array<long>"))
    pairs = pairs.select("a.mask", F.col("a.id").alias("lo"), F.col("b.id").alias("hi"), diff.alias("diff")).join(earlier, "mask")
    again = F.exists("earlier", lambda e: F.col("diff").bitwiseAND(e) == 0)
    return pairs.filter(~again).select("lo", "hi", F.bit_count("diff").alias("distance"))
