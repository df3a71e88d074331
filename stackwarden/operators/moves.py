"""Move plans without name collisions.

Sequential rule per destination, in asset order: a file keeps its name if it is free, else takes
stem_N.ext with the smallest free N. Done without gathering a folder: files that share a name form a
chain with slots 0 (the name), 1, 2, ... A chain's k-th arrival takes its k-th slot that is not taken
from outside: by a file that was there before, or by a mover that is itself called stem_N and came
earlier than the chain got that far. A name has one possible parent chain (strip _N), so chains settle
parents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import _c, dotted_suffix, stem
from ..session import cut_lineage
from .ranking import place_in_group

_CHAIN = ["dest_dir", "name"]
SLOTS_PER_STEP = 4_000
_NUMBERED = r"^(.+)_([1-9][0-9]{0,17})$"


def _parent(name) -> Column:
    base = F.regexp_extract(stem(name), _NUMBERED, 1)
    return F.when(base != "", F.concat(base, dotted_suffix(name)))


def _slot_no(name) -> Column:
    return F.regexp_extract(stem(name), _NUMBERED, 2).try_cast("long")


def _skips(kids: Column, before: Column) -> Column:
    """Which outside slots a chain has to jump over, going up: slot N with limit b is jumped if fewer
    than b were jumped before it (b = N + z - arrivals of the chain before the outside file)."""
    start = F.struct(before.alias("x"), F.array().cast("array<bigint>").alias("skipped"))

    def step(acc: Column, k: Column) -> Column:
        jump = acc["x"] < k["b"]
        return F.struct((acc["x"] + F.when(jump, 1).otherwise(0).cast("long")).alias("x"),
                        F.when(jump, F.concat(acc["skipped"], F.array(k["n"]))).otherwise(acc["skipped"]).alias("skipped"))

    return F.aggregate(kids, start, step, lambda acc: acc["skipped"])


def _jumps(slots: DataFrame, rows_per_task: int, per_step: int = SLOTS_PER_STEP) -> DataFrame:
    """The jumped ones of (dest_dir, parent, n, b). A chain's slots are gone through in steps of bounded
    size, carrying the number jumped so far; nearly always one step does for all chains."""
    keys = ["dest_dir", "parent"]
    placed = cut_lineage(place_in_group(slots, keys, [F.col("n").asc()], "at", rows_per_task=rows_per_task)
                         .withColumn("step", F.floor((F.col("at") - 1) / per_step)))
    last = placed.agg(F.max("step")).first()[0]
    done = None
    for step in range((-1 if last is None else last) + 1):
        part = placed.filter(F.col("step") == step).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("k"))
        so_far = F.lit(0).cast("long")
        if done is not None:
            part = part.join(done.groupBy(*keys).agg(F.count(F.lit(1)).alias("x")), keys, "left")
            so_far = F.coalesce("x", so_far)
        found = cut_lineage(part.select(*keys, F.explode(_skips(F.col("k"), so_far)).alias("n")))
        done = found if done is None else done.unionByName(found)
    return slots.select(*keys, "n").limit(0) if done is None else done


def free_names(movers: DataFrame, existing: DataFrame, rows_per_task: int = 1_000_000,
               slots_per_step: int = SLOTS_PER_STEP) -> DataFrame:
    """(asset_id, dest_dir, name, new_name) for movers (asset_id, dest_dir, name), given what is already
    in the destinations (dest_dir, name)."""
    movers = cut_lineage(movers.select("asset_id", *_CHAIN))
    existing = existing.select(*_CHAIN).distinct()
    names = movers.groupBy(*_CHAIN).agg(F.count(F.lit(1)).alias("m"), F.min("asset_id").alias("first"))
    names = names.join(existing.withColumn("there", F.lit(True)), _CHAIN, "left").withColumn(
        "there", F.coalesce("there", F.lit(False)))
    names = cut_lineage(names.withColumn("parent", _parent("name")).withColumn("n", _slot_no("name")))

    ranked = place_in_group(movers, _CHAIN, [F.col("asset_id").asc()], "r", rows_per_task=rows_per_task)
    kids = cut_lineage(_contested(names, existing))
    if kids.isEmpty():
        z = F.when(F.col("there"), 0).otherwise(1)
        out = ranked.join(names.select(*_CHAIN, z.alias("z")), _CHAIN)
        return _named(out.withColumn("jumped", F.lit(0)))

    # arrivals of the chain before each outside mover
    first_of_kid = kids.filter("first IS NOT NULL AND NOT there").select(
        "dest_dir", F.col("parent").alias("name"), F.col("first").alias("asset_id"), "n")
    in_chain = movers.join(first_of_kid.select(*_CHAIN).distinct(), _CHAIN, "left_semi").withColumn("n", F.lit(None).cast("long"))
    both = place_in_group(in_chain.unionByName(first_of_kid.select(in_chain.columns)), _CHAIN,
                          [F.col("asset_id").asc()], "at", rows_per_task=rows_per_task).filter("n IS NOT NULL")
    alone = place_in_group(first_of_kid, _CHAIN, [F.col("asset_id").asc()], "nth", rows_per_task=rows_per_task)
    before = both.select(*_CHAIN, "n", "at").join(alone.select(*_CHAIN, "n", "nth"), _CHAIN + ["n"]).select(
        "dest_dir", F.col("name").alias("parent"), "n", (F.col("at") - F.col("nth")).alias("a"))
    kids = cut_lineage(kids.join(before, ["dest_dir", "parent", "n"], "left").withColumn("a", F.coalesce("a", F.lit(0))))

    # settle chains from parents to children
    is_kid = kids.filter("first IS NOT NULL").select("dest_dir", F.col("kid").alias("name"))
    level = names.join(is_kid, _CHAIN, "left_anti").select(*_CHAIN, F.when(F.col("there"), 0).otherwise(1).alias("z"))
    levels, skipped = [], []
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        levels.append(level)
        mine = kids.join(level.select("dest_dir", F.col("name").alias("parent"), "z"), ["dest_dir", "parent"])
        b = F.col("n") + F.col("z") - F.col("a")
        jumps = _jumps(mine.select("dest_dir", "parent", "n", b.alias("b")), rows_per_task, slots_per_step)
        skipped.append(jumps)
        own = kids.filter("first IS NOT NULL").join(
            level.select("dest_dir", F.col("name").alias("parent")), ["dest_dir", "parent"], "left_semi")
        own = own.join(jumps.withColumn("kept", F.lit(True)), ["dest_dir", "parent", "n"], "left")
        # a child keeps its own name only if the chain jumped over it and no file was there before
        level = own.select("dest_dir", F.col("kid").alias("name"),
                           F.when(F.col("kept") & ~F.col("there"), 1).otherwise(0).alias("z"))
    z = _union(levels)
    jumps = _union(skipped).withColumnRenamed("parent", "name")

    arrivals = ranked.join(z, _CHAIN)
    # the c-th slot lies beyond the k-th jumped slot s if c >= s - k
    nth = place_in_group(jumps, _CHAIN, [F.col("n").asc()], "k", rows_per_task=rows_per_task)
    marks = nth.select(*_CHAIN, F.lit(None).cast("long").alias("asset_id"), (F.col("n") - F.col("k")).alias("c"), F.lit(0).alias("side"))
    jumping = jumps.select(*_CHAIN).distinct()
    c = arrivals.withColumn("c", F.col("r") - 1 - F.col("z"))
    pos = c.filter("c >= 0").join(jumping, _CHAIN, "left_semi").select(*_CHAIN, "asset_id", "c", F.lit(1).alias("side"))
    placed = place_in_group(pos.unionByName(marks), _CHAIN, [F.col("c").asc(), F.col("side").asc(), F.col("asset_id").asc()],
                            "at", rows_per_task=rows_per_task).filter("side = 1")
    jumped = placed.select("asset_id", (F.col("at") - F.col("c") - 1).alias("jumped"))
    return _named(arrivals.join(jumped, "asset_id", "left"))


def _contested(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Slots of chains that others may sit in: dest_dir, parent, n, kid, first (null: only there before)."""
    chains = names.select("dest_dir", F.col("name").alias("parent"), "m",
                          ((F.col("m") >= 2) | F.col("there")).alias("crowded"))
    there = existing.withColumn("parent", _parent("name")).withColumn("n", _slot_no("name")).filter("parent IS NOT NULL")
    from_movers = names.filter("parent IS NOT NULL").select("dest_dir", "parent", "n", F.col("name").alias("kid"), "first", "there")
    from_disk = there.select("dest_dir", "parent", "n", F.col("name").alias("kid"),
                             F.lit(None).cast("long").alias("first"), F.lit(True).alias("there"))
    kids = from_movers.unionByName(from_disk).groupBy("dest_dir", "parent", "n", "kid").agg(
        F.min("first").alias("first"), F.max("there").alias("there"))
    kids = kids.join(chains, ["dest_dir", "parent"])
    # a chain of m arrivals with q outside slots never gets beyond slot m + q
    q = kids.groupBy("dest_dir", "parent").agg(F.count(F.lit(1)).alias("q"))
    kids = kids.join(q, ["dest_dir", "parent"]).filter(F.col("n") <= F.col("m") + F.col("q"))
    # a lone newcomer overflows only if its own name may be taken by its parent's chain
    mover_kid = from_movers.select("dest_dir", F.col("kid").alias("parent")).distinct().withColumn("below", F.lit(True))
    kids = kids.join(mover_kid, ["dest_dir", "parent"], "left")
    return kids.filter(F.col("crowded") | F.coalesce("below", F.lit(False))).select(
        "dest_dir", "parent", "n", "kid", "first", "there")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(arrivals: DataFrame) -> DataFrame:
    own = (F.col("z") == 1) & (F.col("r") == 1)
    # arrivals at overflow index c take slot c + 1 plus the slots jumped
    slot = F.col("r") - F.col("z") + F.coalesce("jumped", F.lit(0))
    new = F.concat(stem("name"), F.lit("_"), slot.cast("string"), dotted_suffix("name"))
    return arrivals.select("asset_id", *_CHAIN, F.when(own, F.col("name")).otherwise(new).alias("new_name"))


def run_report(tasks: DataFrame) -> DataFrame:
    """Moved, learned, failed over (status, learned) rows of a finished plan."""
    return tasks.agg(F.count_if(_c("status") == "moved").alias("n_moved"), F.count_if(_c("learned")).alias("n_learned"),
                     F.count_if(_c("status") == "error").alias("n_errors"))
