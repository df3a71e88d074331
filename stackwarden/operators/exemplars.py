"""Learned example vectors per folder, and how assets score against them.

Store rows: folder, modality ('image' or 'text'), seq, vec. Everything learned is stored; `latest` cuts a store to the
newest vectors of each folder and modality where that is wanted.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.vectors import as_double, mean_vector, unit
from ..session import BROADCAST_MAX_BYTES, cut_lineage, fresh_path
from .ranking import top_per_group

_KEYS = ["folder", "modality"]
BLOCK_EXEMPLARS = 8192
# Examples of a folder that stay together; a larger folder is split
SLICE_ROWS = 4096
BLOCK_QUERIES = 8192
SHARE_BYTES = 32 << 20  # of a store that is too large to broadcast; the driver packs a share, and a worker holds it
SCORES = 1 << 21  # scores of queries against folders that are held at once


def latest(store: DataFrame, keep: int = K.EXEMPLARS_PER_FOLDER) -> DataFrame:
    return top_per_group(store, _KEYS, [F.col("seq").desc()], keep, "_r").drop("_r")


def centroids(store: DataFrame) -> DataFrame:
    """Mean of the retained vectors, scaled to length one. Partial sums combine map-side."""
    return store.groupBy(*_KEYS).agg(mean_vector("vec").alias("m")).select(*_KEYS, unit("m").alias("centroid"))


def pooled(frames: DataFrame, masked: bool = False) -> DataFrame:
    """Mean of an asset's frame vectors (or of its unmasked token vectors), scaled to length one.

    Frames that cancel out give no vector; tokens that do keep their plain mean.
    """
    f = frames.filter("mask = 1") if masked else frames
    m = f.groupBy("asset_id").agg(mean_vector("vec").alias("m"))
    out = m.select("asset_id", unit("m").alias("vec"), F.aggregate(
        "m", F.lit(0.0), lambda a, x: a + x * x).alias("sq"))
    return (out if masked else out.filter(F.sqrt("sq") >= 1e-9)).select("asset_id", "vec")


def counts(store: DataFrame) -> DataFrame:
    return store.groupBy("folder").agg(
        F.count_if(F.col("modality") == "image").alias("n_image"),
        F.count_if(F.col("modality") == "text").alias("n_text"))


def known_names(store: DataFrame) -> DataFrame:
    return store.select("folder").distinct()


def clear_folder(store: DataFrame, folder: str) -> DataFrame:
    return store.filter(F.col("folder") != folder)


def name_only_folders(store: DataFrame) -> DataFrame:
    """Folders with exactly one text vector and no image vector: most likely just their seeded name."""
    return counts(store).filter("n_text = 1 AND n_image = 0").select("folder")


def purge_name_only(store: DataFrame) -> DataFrame:
    return store.join(name_only_folders(store), "folder", "left_anti")


# --- scoring ------------------------------------------------------------------------------------
# A folder of one modality is cut into slices of bounded size, so that no task and no value holds a whole folder. Its
# centroid comes from map-side sums and goes to every block that has one of its slices. The blend grows with the best
# example, so the best slice gives the folder's score, and a block may cut to its own best n folders at once.
@dataclass
class Side:
    """Examples of one modality in a block: folders in order, where each begins, all vectors, whole folders' centroids."""

    folders: list
    starts: np.ndarray
    mat: np.ndarray
    cents: np.ndarray


def _side(pdf: pd.DataFrame) -> Side:
    own = pdf[~pdf["centre"]].sort_values(["folder", "seq"], kind="stable")
    folders, starts = np.unique(own["folder"].to_numpy(dtype=object), return_index=True)
    cents = pdf[pdf["centre"]].set_index("folder")["vec"]
    return Side(list(folders), starts, np.stack(own["vec"].to_numpy()).astype("float64"), np.stack([cents[f] for f in folders]).astype("float64"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    sides = {m: _side(part) for m, part in pdf.groupby("modality")}
    return pd.DataFrame({"side": [pdf["side"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "payload": [pickle.dumps(sides)]})


def _blend(q: np.ndarray, side: Side) -> np.ndarray:
    best = np.empty((len(q), len(side.folders)))
    for at in range(0, len(q), QUERY_TILE):  # products of a tile with a block, not of all queries with it
        best[at:at + QUERY_TILE] = np.maximum.reduceat(q[at:at + QUERY_TILE] @ side.mat.T, side.starts, axis=1)
    return 0.6 * best + 0.4 * (q @ side.cents.T)


def _cones(side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each folder of a block: direction of the middle of its vectors, widest angle to it, longest vector, middle."""
    sizes = np.diff(np.append(side.starts, len(side.mat)))
    mids = np.add.reduceat(side.mat, side.starts, axis=0) / sizes[:, None]
    axis = mids / np.maximum(np.linalg.norm(mids, axis=1, keepdims=True), 1e-12)
    length = np.linalg.norm(side.mat, axis=1)
    cos = np.einsum("ij,ij->i", side.mat, np.repeat(axis, sizes, axis=0)) / np.maximum(length, 1e-12)
    widest = np.arccos(np.clip(np.minimum.reduceat(cos, side.starts), -1.0, 1.0))
    return axis, widest, np.maximum.reduceat(length, side.starts), mids


QUERY_TILE = 256
SLACK = 1e-9


def _best_blend(q: np.ndarray, side: Side, top_n: int, done: list | None = None) -> np.ndarray:
    """As _blend, with nan for folders that cannot be among a query's best n of this block. The best example of a folder
    lies within its cone, which bounds the score from above; the middle of its vectors bounds it from below. Queries go
    in tiles that prefer the same folder; a folder that no query of a tile can want is not multiplied. `done` takes the
    number of products, and of all there are."""
    if top_n >= len(side.folders) or not len(q):
        return _blend(q, side)
    axis, widest, longest, mids = _cones(side)
    size = np.linalg.norm(q, axis=1)
    by_cent = 0.4 * (q @ side.cents.T)
    angle = np.arccos(np.clip(q @ axis.T / np.maximum(size, 1e-12)[:, None], -1.0, 1.0))
    reach = np.cos(np.minimum(np.maximum(angle - widest[None, :], 0.0), np.pi))
    # a product below zero is largest for the shortest vector; zero is a bound for any of them
    above = 0.6 * np.maximum(reach, 0.0) * longest[None, :] * size[:, None] + by_cent
    below = 0.6 * (q @ mids.T) + by_cent
    floor = -np.partition(-below, top_n - 1, axis=1)[:, top_n - 1]
    wanted = above >= floor[:, None] - SLACK
    sizes = np.diff(np.append(side.starts, len(side.mat)))
    out = np.full(by_cent.shape, np.nan)
    order = np.argsort(np.argmax(below, axis=1), kind="stable")
    for at in range(0, len(q), QUERY_TILE):
        tile = order[at:at + QUERY_TILE]
        f = np.flatnonzero(wanted[tile].any(axis=0))
        rows = np.concatenate([np.arange(side.starts[i], side.starts[i] + sizes[i]) for i in f])
        begins = np.cumsum(sizes[f]) - sizes[f]
        best = np.maximum.reduceat(q[tile] @ side.mat[rows].T, begins, axis=1)
        out[np.ix_(tile, f)] = 0.6 * best + by_cent[np.ix_(tile, f)]
        if done is not None:
            done.append((len(tile) * len(rows), len(tile) * len(side.mat)))
    return out


def _best(ids, modality, folders, s: np.ndarray, top_n: int | None) -> pd.DataFrame:
    """The best n folders of each row of scores; nan is no score, equal scores stay in folder order."""
    s = np.where(np.isnan(s), -np.inf, s)
    k = len(folders) if top_n is None else min(top_n, len(folders))
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    out = pd.DataFrame({
        "asset_id": np.repeat(ids, k), "modality": pd.Series([modality] * (len(ids) * k), dtype=object),
        "folder": pd.Series(np.array(folders, dtype=object)[order].ravel(), dtype=object),
        "score": np.take_along_axis(s, order, axis=1).ravel(),
    })
    return out[out["score"] > -np.inf]


_SCORED = "asset_id long, modality string, folder string, score double"


def _shares(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int]]]:
    """Blocks (side, block, rows) dealt in order into shares of at most so many rows, or of one block."""
    out: list[list[tuple[str, int]]] = []
    left = 0
    for side, block, rows in sorted(sizes):
        if not out or rows > left:
            out.append([])
            left = most
        out[-1].append((side, block))
        left -= rows
    return out


def _against(queries: DataFrame, side: Column, store: DataFrame, score, broadcast_bytes: int) -> DataFrame:
    """score(queries, sides, side) for each block of queries and of exemplars. Store rows have side and key (rows of one
    side and key share a block) and vec; `side` tells what a query is compared with. The exemplars are broadcast if their
    counted size allows, else one share of bounded size after the other, so neither blocks nor queries are shuffled to meet,
    and the best score of a query and folder is what a share leaves."""
    n, dim = store.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    small = (n or 0) * (dim or 0) * 8 <= broadcast_bytes
    n_blocks = max(1, math.ceil((n or 0) / BLOCK_EXEMPLARS))
    placed = store.withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int")).drop("key")
    own = placed.select("side", "block", *_KEYS, "seq", "vec", F.lit(False).alias("centre"))
    mid = placed.select("side", "block", *_KEYS).distinct().join(centroids(store).withColumnRenamed("centroid", "vec"), _KEYS)
    rows = own.unionByName(mid.select("side", "block", *_KEYS, F.lit(None).cast("long").alias("seq"), "vec", F.lit(True).alias("centre")))
    spark = queries.sparkSession

    def scores(part: pd.DataFrame, payload: bytes, side: str):
        sides = pickle.loads(payload)
        step = max(1, min(BLOCK_QUERIES, SCORES // max(len(s.folders) for s in sides.values())))
        for at in range(0, len(part), step):
            yield score(part.iloc[at:at + step], sides, side)

    def packed(some: DataFrame) -> Broadcast:
        held: dict[str, list[bytes]] = {}
        for r in some.groupBy("side", "block").applyInPandas(_pack, "side string, block int, payload binary").collect():  # counted
            held.setdefault(r.side, []).append(bytes(r.payload))
        return spark.sparkContext.broadcast(held)

    def scored(q: DataFrame, shared: Broadcast) -> DataFrame:
        def each(batches):
            for pdf in batches:
                for side, part in pdf.groupby("side"):
                    for payload in shared.value.get(side, ()):
                        yield from scores(part, payload, side)

        return q.mapInPandas(each, _SCORED)

    if small:
        return scored(queries.withColumn("side", side), packed(rows))
    rows, queries = cut_lineage(rows), cut_lineage(queries)
    sizes = [(r.side, r.block, r["count"]) for r in rows.groupBy("side", "block").count().collect()]
    kept, parts = fresh_path(spark, "scores"), []
    for share in _shares(sizes, min(broadcast_bytes, SHARE_BYTES) // (8 * dim)):
        sides = sorted({s for s, _ in share})
        mine = [(F.col("side") == s) & F.col("block").isin([b for x, b in share if x == s]) for s in sides]
        shared = packed(rows.filter(reduce(or_, mine)))
        found = scored(queries.withColumn("side", side).filter(F.col("side").isin(sides)), shared)
        found.groupBy("asset_id", *reversed(_KEYS)).agg(F.max("score").alias("score")).write.parquet(f"{kept}/share-{len(parts)}")
        parts.append(f"{kept}/share-{len(parts)}")
        shared.destroy()
    return spark.read.schema(_SCORED).parquet(*parts)


def _with_slice(store: DataFrame, groups: list[str], slice_rows: int) -> DataFrame:
    """Adds slices, the number of slices of a row's group, and slice, its own. Counts combine map-side."""
    n = store.groupBy(*groups).count().select(*groups, F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    return store.join(n, groups).withColumn("slice", F.pmod(F.xxhash64("seq", "vec"), "slices"))


def folder_scores(
    queries: DataFrame,
    store: DataFrame,
    top_n: int | None = None,
    min_exemplars: int = 1,
    broadcast_bytes: int = BROADCAST_MAX_BYTES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(asset_id, modality, folder, score): 0.6 x best exemplar + 0.4 x centroid. Takes (asset_id, modality, vec)."""
    store = store.select(*_KEYS, "seq", as_double("vec").alias("vec"))
    if min_exemplars > 1:
        enough = store.groupBy(*_KEYS).count().filter(F.col("count") >= min_exemplars).select(*_KEYS)
        store = store.join(enough, _KEYS, "left_semi")

    def score(part: pd.DataFrame, sides: dict, modality: str) -> pd.DataFrame:
        q, side = np.stack(part["vec"].to_numpy()), sides[modality]
        s = _blend(q, side) if top_n is None else _best_blend(q, side, top_n)
        return _best(part["asset_id"].to_numpy(), modality, side.folders, s, top_n)

    q = queries.select("asset_id", "modality", as_double("vec").alias("vec"))
    sliced = _with_slice(store, _KEYS, slice_rows).select(
        *_KEYS, "seq", "vec", F.col("modality").alias("side"), F.xxhash64("folder", "slice").alias("key"))
    best = _against(q, F.col("modality"), sliced, score, broadcast_bytes).groupBy("asset_id", "modality", "folder").agg(F.max("score").alias("score"))
    return best if top_n is None else top_folders(best, top_n, ["asset_id", "modality"]).drop("rank")


def combined_scores(queries: DataFrame, store: DataFrame, top_n: int | None = None,
                    broadcast_bytes: int = BROADCAST_MAX_BYTES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(asset_id, folder, score): one score per asset and folder, 55/45 where both sides know the folder, 85 % of the
    one score otherwise; or the best n of all folders. A folder of one slice has both modalities in one block, where
    they are combined and cut to the best n. Of the folders that are split, of which a store of n vectors has at most
    n / slice_rows, all partial scores are sent on, as their sides meet only behind the blocks."""

    def side(m: str):
        return F.first(F.when(F.col("modality") == m, as_double("vec")), ignorenulls=True).alias(m)

    q = queries.groupBy("asset_id").agg(side("image"), side("text"))

    def score(part: pd.DataFrame, sides: dict, kind: str) -> pd.DataFrame:
        names = np.array(sorted(set().union(*(s.folders for s in sides.values()))), dtype=object)
        one, ids = {}, part["asset_id"].to_numpy()
        for m in ("image", "text"):
            one[m] = np.full((len(part), len(names)), np.nan)
            have = np.flatnonzero(part[m].notna().to_numpy())
            if m in sides and len(have):
                at = np.searchsorted(names, np.array(sides[m].folders, dtype=object))
                one[m][np.ix_(have, at)] = _blend(np.stack(part[m].to_numpy()[have]), sides[m])
        if kind == "split":
            return pd.concat([_best(ids, m, names, s, None) for m, s in one.items()])
        i, t = one["image"], one["text"]
        both = np.where(np.isnan(t), 0.85 * i, np.where(np.isnan(i), 0.85 * t, 0.55 * i + 0.45 * t))
        return _best(ids, None, names, both, top_n)

    sliced = _with_slice(store.select(*_KEYS, "seq", as_double("vec").alias("vec")), ["folder"], slice_rows)
    split = F.col("slices") > 1
    sliced = sliced.select(*_KEYS, "seq", "vec", F.when(split, "split").otherwise("whole").alias("side"),
                           F.when(split, F.xxhash64("folder", "slice")).otherwise(F.xxhash64("folder")).alias("key"))
    scored = _against(q, F.explode(F.array(F.lit("whole"), F.lit("split"))), sliced, score, broadcast_bytes)
    i, t = (F.max(F.when(F.col("modality") == m, F.col("score"))) for m in ("image", "text"))
    parts = scored.filter("modality IS NOT NULL").groupBy("asset_id", "folder").agg(i.alias("i"), t.alias("t"))
    both = F.when(F.col("t").isNull(), 0.85 * F.col("i")).when(F.col("i").isNull(), 0.85 * F.col("t")).otherwise(0.55 * F.col("i") + 0.45 * F.col("t"))
    scored = scored.filter("modality IS NULL").select("asset_id", "folder", "score").unionByName(
        parts.select("asset_id", "folder", both.alias("score")))
    return scored if top_n is None else top_folders(scored, top_n).drop("rank")


def top_folders(scores: DataFrame, n: int, groups=("asset_id",)) -> DataFrame:
    return top_per_group(scores, list(groups), [F.col("score").desc(), F.col("folder").asc()], n)


def decide(scores: DataFrame) -> DataFrame:
    """The semantic suggestion, if the best folder is good enough and clear enough of the second."""
    two = top_folders(scores, 2)
    w = W.partitionBy("asset_id").orderBy("rank")
    s = two.withColumn("second", F.lead("score", 1, -1.0).over(w)).filter("rank = 1")
    top, gap = F.col("score"), F.col("score") - F.col("second")
    strong = top >= 0.70
    match = (top >= 0.45) & (gap >= 0.02)
    weak = (top >= 0.35) & (gap >= 0.05)
    conf = (
        F.when(strong, F.least(F.lit(0.95), 0.80 + top * 0.15))
        .when(match, F.least(F.lit(0.85), 0.65 + (top - 0.45) * 0.5 + gap * 0.3))
        .when(weak, F.least(F.lit(0.55), 0.40 + (top - 0.35) * 0.5))
    )
    reason = F.when(strong, "semantic_strong").when(match, "semantic_match").when(weak, "semantic_weak")
    return s.select("asset_id", "folder", conf.alias("confidence"), reason.alias("reason")).filter("reason IS NOT NULL")


def explain(scores: DataFrame, store: DataFrame, n: int = 5) -> DataFrame:
    """Top folders of an asset with the number of examples behind them."""
    return top_folders(scores, n).join(counts(store), "folder", "left").select(
        "asset_id", "rank", "folder", "score",
        F.coalesce("n_image", F.lit(0)).alias("n_image"), F.coalesce("n_text", F.lit(0)).alias("n_text"))
