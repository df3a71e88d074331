"""Document fingerprints of 128 bits by SimHash, and search within a Hamming radius. DataFrame functions only.

Terms are pairs of neighbouring words, weighted by the length of the first. Each term's two 64-bit hashes vote on the
bits with its weight; a bit is set if more than half of the weight sets it. Votes are added in one aggregation: a sum
holds two counters, one per half word, so 64 sums count 128 bits.

Search cuts fingerprints into blocks, two more than the radius. However the radius's bits are placed, two blocks at
least stay equal, so for each pair of blocks a table is keyed by those two, moved to the front; rows with equal keys
are compared, and a pair counts in the first table that holds it.

Comparing each document with the next one needs no global sort: doc_ids are cut into ranges at estimated quantiles,
each range is sorted on its own, and the first rows of a range are also dealt to the range before (of the last range,
to the first), where they only lend their text. The order is doc_id, then text; a null doc_id comes first. Rows with
one doc_id share a range.

Input: doc_id, text (null: empty; no words: fingerprint zero). Repeated rows follow each other. A single row is its
own next. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_and_text

WORD = r"[^\x20\x09-\x0D]+"
MAX_WEIGHT = 8
BITS = 128
RADIUS = 3
RANGES_PER_PARTITION = 4
MAX_RANGES = 4096
LOWEST = -(1 << 63)
LANES = 0x0000000100000001


def vote_sums(h: str = "h", w: str = "w") -> list[Column]:
    """64 sums of two counters each, and the weight in all."""
    out = []
    for half in range(2):
        x = h if half == 0 else f"xxhash64({h})"
        out += [F.expr(f"sum((shiftrightunsigned({x}, {i}) & {LANES}L) * {w})").alias(f"c{half}_{i}") for i in range(32)]
    return [*out, F.sum(w).alias("weight")]


def fingerprint_of() -> list[Column]:
    """hi and lo of the fingerprint, from vote_sums."""
    halves = []
    for half, name in ((0, "lo"), (1, "hi")):
        bits = [f"if(2 * (c{half}_{i} & 4294967295L) > weight, {1 << i}L, 0L) | "
                f"if(2 * shiftrightunsigned(c{half}_{i}, 32) > weight, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
        halves.append(F.expr("coalesce(" + " | ".join(bits) + ", 0L)").alias(name))
    return halves


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.expr(f"cast(bit_count({a[0]} ^ {b[0]}) + bit_count({a[1]} ^ {b[1]}) as int)")


def likeness(d: Column) -> Column:
    """Estimated cosine of the weighted terms: 1 for equal fingerprints, 0 from half of the bits on."""
    return F.round(F.greatest(F.lit(0.0), F.cos(d * F.lit(3.141592653589793 / BITS))), 6)


def ranges(docs: DataFrame, per_partition: int = RANGES_PER_PARTITION) -> tuple[list[int], dict[int, int]]:
    """Lower bounds of all ranges but the first; of each range's first doc_id, the range before it. Reads ids only."""
    spark = docs.sparkSession
    n = min(MAX_RANGES, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("k")
    cuts = docs.select(k).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bounds = sorted(set(cuts or []))
    firsts = {r["r"]: r["first"] for r in docs.select(k).select(range_of(bounds).alias("r"), "k").groupBy("r").agg(F.min("k").alias("first")).collect()}
    used = sorted(firsts)
    return bounds, {firsts[r]: used[i - 1] for i, r in enumerate(used)}


def range_of(bounds: list[int]) -> Column:
    """Number of bounds up to k, by bisection over a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = "array(" + ", ".join(_long(b) for b in bounds) + ")"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) -> "
                  f"if(lo + s <= {len(bounds)} and element_at({at}, least(lo + s, {len(bounds)})) <= k, lo + s, lo))")


def _long(v: int) -> str:
    return "(-9223372036854775807L - 1L)" if v == LOWEST else f"{v}L"


def with_edited(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, lo, hi, edited_lo, edited_hi, next_lo, next_hi. The edited
    text ends in as many characters of the next document as half its own. Texts are shuffled once."""
    bounds, before = ranges(docs)
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("k"))
    rows = rows.withColumn("r", range_of(bounds))
    if before:
        lend = ", ".join(f"{_long(first)}, {r}" for first, r in before.items())
        firsts = ", ".join(_long(first) for first in before)
        rows = rows.select("doc_id", "text", "k", F.inline(F.expr(
            f"if(k in ({firsts}), array(named_struct('r', r, 'lent', 0), named_struct('r', element_at(map({lend}), k), 'lent', 1)), "
            f"array(named_struct('r', r, 'lent', 0)))")))
    else:
        rows = rows.withColumn("lent", F.lit(0))
    w = Window.partitionBy("r").orderBy("lent", "k", "text")
    rows = rows.select("r", "lent", "doc_id", "text", F.row_number().over(w).alias("n"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("after"))
    half = F.expr("cast(floor(length(text) / 2) as int)")
    rows = rows.select("r", "n", "lent", "doc_id", "text", F.length("text").cast("long").alias("n_chars"),
                       F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("after", F.lit(1), half)).alias("edited"))
    rows = rows.select("r", "n", "lent", "doc_id", "n_chars", F.when(F.col("lent") == 0, F.sha2("edited", 256)).alias("edited_sha256"), F.explode(
        F.when(F.col("lent") == 0, F.array(F.struct(F.lit(0).alias("e"), "text"), F.struct(F.lit(1).alias("e"), F.col("edited").alias("text"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("e"), "text")))).alias("x"))
    keys = ["r", "n", "lent", "doc_id", "n_chars", "edited_sha256", "e"]
    words = rows.select(*keys[:-1], F.col("x.e").alias("e"), F.regexp_extract_all(F.lower("x.text"), F.lit(WORD), 0).alias("words"))
    votes = words.select(*keys, F.explode_outer(F.transform("words", lambda x, i: F.struct(
        F.xxhash64(x, F.get("words", i + 1)).alias("h"), F.least(F.length(x), F.lit(MAX_WEIGHT)).cast("long").alias("w")))).alias("v"))
    votes = votes.select(*keys, F.col("v.h").alias("h"), F.col("v.w").alias("w"))
    prints = votes.groupBy(*keys).agg(*vote_sums()).select(*keys, *fingerprint_of())
    own, edited = F.col("e") == 0, F.col("e") == 1
    prints = prints.groupBy(*keys[:-1]).agg(
        *(F.max(F.when(is_e, F.col(c))).alias(p + c) for p, is_e in (("", own), ("edited_", edited)) for c in ("lo", "hi")))
    after = Window.partitionBy("r").orderBy("n")
    prints = prints.select("*", F.lead("lo").over(after).alias("next_lo"), F.lead("hi").over(after).alias("next_hi"))
    return prints.filter("lent = 0").select("doc_id", "n_chars", "edited_sha256", "lo", "hi", "edited_lo", "edited_hi", "next_lo", "next_hi")


def block_keys(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(lo, hi) masks of each table's two blocks."""
    m = radius + 2
    blocks = [sum(1 << b for b in range(BITS * i // m, BITS * (i + 1) // m)) for i in range(m)]
    return [((x := blocks[i] | blocks[j]) & (1 << 64) - 1, x >> 64) for i, j in combinations(range(m), 2)]


def _mask(v: int) -> str:
    v = v - (1 << 64) if v >> 63 else v
    return _long(v)


def tables(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: lo, hi and others; one row per table, with its number and key."""
    each = ", ".join(f"named_struct('t', {t}, 'kl', lo & {_mask(a)}, 'kh', hi & {_mask(b)})" for t, (a, b) in enumerate(block_keys(radius)))
    return prints.select("*", F.inline(F.expr(f"array({each})")))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """queries: distinct lo, hi. prints: distinct lo, hi with n, the documents that have it. Returns lo, hi, n_near:
    the documents within the radius."""
    q = tables(queries.select("lo", "hi"), radius).select(F.col("lo").alias("ql"), F.col("hi").alias("qh"), "t", "kl", "kh")
    p = tables(prints.select("lo", "hi", "n"), radius)
    pairs = q.join(p, ["t", "kl", "kh"]).filter(distance(("ql", "qh"), ("lo", "hi")) <= radius)
    x, y = "(ql ^ lo)", "(qh ^ hi)"
    earlier = " or ".join(f"(t > {t} and {x} & {_mask(a)} = 0 and {y} & {_mask(b)} = 0)" for t, (a, b) in enumerate(block_keys(radius)))
    return pairs.filter(~F.expr(f"({earlier})")).groupBy(F.col("ql").alias("lo"), F.col("qh").alias("hi")).agg(F.sum("n").alias("n_near"))


def compare_with_next(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """with_edited, likenesses, and for documents whose id is divisible by 20 the number of documents (its own
    included) with a fingerprint within the radius; else null."""
    rows = cut_lineage(with_edited(docs))
    prints = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"))
    asked = rows.filter("doc_id % 20 = 0").select("lo", "hi").distinct()
    found = search(asked, prints, radius).select(F.col("lo").alias("fl"), F.col("hi").alias("fh"), "n_near")
    asks = rows.filter("doc_id % 20 = 0").join(found, (F.col("lo") == F.col("fl")) & (F.col("hi") == F.col("fh"))).drop("fl", "fh")
    rest = rows.filter("coalesce(doc_id % 20, 1) <> 0").withColumn("n_near", F.lit(None).cast("long"))
    all_rows = asks.unionByName(rest)
    text = lambda p: F.lower(F.concat(F.lpad(F.hex(p + "hi"), 16, "0"), F.lpad(F.hex(p + "lo"), 16, "0")))
    return all_rows.select(
        "doc_id", "n_chars", "edited_sha256", text("").alias("fingerprint"), text("edited_").alias("edited_fingerprint"),
        likeness(distance(("lo", "hi"), ("edited_lo", "edited_hi"))).alias("near_edited"),
        likeness(distance(("lo", "hi"), ("next_lo", "next_hi"))).alias("near_next"), "n_near")
