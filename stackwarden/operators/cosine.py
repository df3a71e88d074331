"""Cosine-threshold joins and clusters, exact, as matrix products of blocks that can hold near vectors.

Vectors are stored by cell and ring: a cell is what lies nearest to one of a bounded number of pivots, a ring is a range of
angles to that pivot. By the triangle inequality on angles, a vector can be near to members of a cell only if its angle to
the pivot is at most the cell's widest plus the threshold's, and at most its own nearest pivot's plus twice the threshold's;
it visits these cells. In a cell, rings that touch or are equal meet, in blocks of bounded size, whatever a cell holds.
Only what passes the threshold is returned. On vectors without any clusters every cell would be visited, and a vector sent
to each: where drawn vectors show that, all form one cell in wide blocks instead. Then N^2 / 2 products are done, and each
vector is sent once per block.

Input: vectors of any length; a pair is near if its product reaches the threshold. Clusters take unit vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from ..session import cut_lineage
from .leaders import EDGES_PER_TASK, elect

BLOCK_ROWS = 4096
PIVOTS = 256
MAX_RINGS = 64
SLACK = 1e-6  # more than the error of an arc cosine
DIRECT_EDGES_UP_TO = 5_000  # so few vectors cannot have more than 12.5 million pairs
EDGES_PER_VECTOR = 32
WIDE = 4  # so many times the rows has a block where cells do not help
WIDE_BYTES = 8 << 20  # unless it holds more than this
DRAWN = 1024  # vectors that tell whether cells help
VISITED_FROM = 0.25  # they do not if a vector visits this part of them
SLICE_ROWS = 512  # rows of a block that meet the other block at once
TILE_ROWS = 4096  # rows of that other block in one product
FEW_HITS = 8192  # rough hits of a product that are looked at one by one
PAIR_ROWS = 1 << 17  # pairs handed on at once
PLACED_ROWS = 8192  # rows handed on at once; a vector can have a place in every cell
BATCH_ROWS = 5_000  # the first batch of ids; each one after is twice as large


@dataclass(frozen=True)
class Cells:
    """Pivots, the widest angle of each one's own vectors, the threshold as an angle, and the width of a ring."""

    pivots: np.ndarray
    widest: np.ndarray
    near: float
    width: float

    def angles(self, vec: np.ndarray) -> np.ndarray:
        length = np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
        return np.arccos(np.clip(vec / length @ self.pivots.T, -1.0, 1.0))

    def ring(self, angle: np.ndarray) -> np.ndarray:
        return np.floor(angle / self.width).astype(np.int32)

    def homes(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and ring of each vector's own place."""
        a = self.angles(vec)
        cell = np.argmin(a, axis=1)
        return np.arange(len(vec)), cell.astype(np.int32), self.ring(a[np.arange(len(vec)), cell])

    def visits(self, vec: np.ndarray, lower_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and ring of the other places where a vector's near ones can be; lower cells only if the vectors meet
        one another, so that of two cells one visits the other."""
        a = self.angles(vec)
        own = np.argmin(a, axis=1)
        can = a <= np.minimum(self.widest[None, :] + self.near, a.min(axis=1, keepdims=True) + 2 * self.near) + SLACK
        if lower_only:
            can &= np.arange(a.shape[1])[None, :] < own[:, None]
        i, cell = np.nonzero(can)
        return i, cell.astype(np.int32), self.ring(a[i, cell])


def _draw(vectors: DataFrame, n: int) -> np.ndarray:
    """n vectors at most, drawn by a hash of their id."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(n).select("vec").collect()
    return np.array([r.vec for r in rows], dtype="float64")


def _near_angle(threshold: float, length: float) -> float:
    """The shorter the vectors, the closer a pair must be to reach the threshold."""
    return math.acos(min(1.0, threshold / max(length, 1e-12)))


def _visited(pivots: np.ndarray, home: np.ndarray, guests: np.ndarray, threshold: float) -> float:
    """The part of all cells that drawn vectors visit, by the widest angles of drawn vectors; that of all are wider."""
    cells = Cells(pivots, np.zeros(len(pivots)), math.pi, math.pi)
    a = cells.angles(home)
    reach = np.zeros(len(pivots))
    np.maximum.at(reach, np.argmin(a, axis=1), a.min(axis=1))
    near = _near_angle(threshold, np.linalg.norm(home, axis=1).max() * np.linalg.norm(guests, axis=1).max())
    i, _, _ = Cells(pivots, reach, near, math.pi).visits(guests, False)
    return len(i) / (len(guests) * len(pivots))


def _cells(home: DataFrame, pivots: np.ndarray, guests: DataFrame | None, threshold: float) -> Cells:
    """The cells of the home vectors around the pivots."""
    first = Cells(pivots, np.zeros(len(pivots)), math.pi, math.pi)

    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vec = np.stack(pdf["vec"].to_numpy())
                a = first.angles(vec)
                own = np.argmin(a, axis=1)
                got = pd.DataFrame({"cell": own.astype("int32"), "angle": a[np.arange(len(a)), own], "length": np.linalg.norm(vec, axis=1)})
                yield got.groupby("cell", as_index=False).max()

    top = F.max("length").alias("length")
    got = home.select("vec").mapInPandas(widest, "cell int, angle double, length double").groupBy("cell").agg(F.max("angle").alias("angle"), top).collect()
    reach = np.zeros(len(pivots))
    for r in got:
        reach[r.cell] = r.angle
    long = other = max(r.length for r in got)
    if guests is not None:
        other = guests.select("vec").mapInPandas(widest, "cell int, angle double, length double").agg(top).first().length or 0.0
    near = _near_angle(threshold, long * other)
    return Cells(pivots, reach, near, max(near + SLACK, math.pi / MAX_RINGS))


_PLACE = ["cell", "ring", "home"]


@dataclass
class Meetings:
    """Vectors in their blocks, and which blocks meet."""

    placed: DataFrame
    sizes: dict[tuple[int, int, bool], int]
    block_rows: int
    guests_only: bool = False

    def parts(self, place: tuple[int, int, bool]) -> int:
        return max(1, math.ceil(self.sizes.get(place, 0) / self.block_rows))

    def pairs(self) -> Iterator[tuple[tuple[int, int, bool], tuple[int, int, bool]]]:
        for cell, ring, home in self.sizes:
            if home:
                for other in (-1, 0, 1):
                    for kind in (True, False):
                        there = (cell, ring + other, kind)
                        if there in self.sizes and (not kind or other >= 0) and not (kind and self.guests_only):
                            yield (cell, ring, True), there

    @property
    def products(self) -> int:
        """Vector products of all meetings."""
        return sum(self.sizes[x] * self.sizes[y] // (2 if x == y else 1) for x, y in self.pairs())

    def run(self, meet: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """meet(one or two packed blocks, the first one home) for every meeting, each in a group of its own. What it
        yields is handed on piece by piece."""
        def alone_group(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from meet(_pack(pd.concat(parts)).assign(side=0))

        def group(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from meet(pd.concat(parts))

        spark = self.placed.sparkSession
        if len(self.sizes) == 1 and max(self.parts(x) for x in self.sizes) == 1:  # a single block
            return self.placed.groupBy(*_PLACE, "sub").applyInPandas(alone_group, schema)
        rows, n = [], 0
        for x, y in self.pairs():
            a, b = self.parts(x), self.parts(y)
            rows.append((x[0], x[1], a, y[1], y[2], b))
            n += a * b
        plan = spark.createDataFrame(rows, "cell int, r1 int, n1 int, r2 int, h2 boolean, n2 int")
        plan = plan.withColumn("s1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
        same = (F.col("r1") == F.col("r2")) & F.col("h2")
        plan = plan.filter(~same | (F.col("s1") <= F.col("s2"))).select("cell", "r1", "s1", "r2", "h2", "s2")
        keys = plan.columns
        packed = self.placed.groupBy(*_PLACE, "sub").applyInPandas(_pack, "cell int, ring int, home boolean, sub int, dim int, ids binary, mat binary")
        one = packed.filter("home").select(F.col("cell"), F.col("ring").alias("r1"), F.col("sub").alias("s1"), F.lit(0).alias("side"), "dim", "ids", "mat")
        two = packed.select("cell", F.col("ring").alias("r2"), F.col("home").alias("h2"), F.col("sub").alias("s2"), F.lit(1).alias("side"), "dim", "ids", "mat")
        alone = same & (F.col("s1") == F.col("s2"))
        both = one.join(plan, ["cell", "r1", "s1"]).select(*keys, "side", "dim", "ids", "mat").unionByName(
            two.join(plan.filter(~alone), ["cell", "r2", "h2", "s2"]).select(*keys, "side", "dim", "ids", "mat"))
        return both.repartition(max(1, min(n, 20_000)), *keys).groupBy(*keys).applyInPandas(group, schema)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    mat = np.stack(pdf["vec"].to_numpy()).astype("float64")
    return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in (*_PLACE, "sub")}, "dim": [mat.shape[1]],
                         "ids": [pdf["id"].to_numpy("int64").tobytes()], "mat": [mat.tobytes()]})


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype="int64")
    return ids, np.frombuffer(row.mat, dtype="float64").reshape(len(ids), row.dim)


def meetings(home: DataFrame, threshold: float, block_rows: int, rows: int | None = None, guests: DataFrame | None = None) -> Meetings:
    """How (id, vec) meet one another, or, if given, how guests (id, vec) meet them."""
    home = home.select("id", as_double("vec").alias("vec"))
    guests = None if guests is None else guests.select("id", as_double("vec").alias("vec"))
    rows = home.count() if rows is None else rows
    k = min(PIVOTS, rows // max(1, block_rows // 4)) if rows > block_rows and threshold > 0 else 1
    if k == 1:
        return _one_cell(home, rows, guests, block_rows)
    drawn = _draw(home, k + DRAWN)
    pivots = drawn[:k] / np.maximum(np.linalg.norm(drawn[:k], axis=1, keepdims=True), 1e-12)
    seen = drawn[k:] if guests is None else _draw(guests, DRAWN)
    if len(seen) and _visited(pivots, drawn[k:], seen, threshold) > VISITED_FROM:
        wide = min(WIDE * block_rows, WIDE_BYTES // (8 * max(1, drawn.shape[1])))
        return _one_cell(home, rows, guests, max(block_rows, wide))
    cells = _cells(home, pivots, guests, threshold)
    shared = home.sparkSession.sparkContext.broadcast(cells)

    def places(vecs: np.ndarray, kind: str) -> Iterator[tuple[bool, tuple]]:
        """In pieces of bounded size, however many cells are visited."""
        for at in range(0, len(vecs), SLICE_ROWS):
            vec = np.stack(vecs[at:at + SLICE_ROWS])
            if kind != "guests":
                i, cell, ring = shared.value.homes(vec)
                yield True, (i + at, cell, ring)
            if kind != "home":
                i, cell, ring = shared.value.visits(vec, kind == "both")
                for j in range(0, len(i), PLACED_ROWS):
                    yield False, (i[j:j + PLACED_ROWS] + at, cell[j:j + PLACED_ROWS], ring[j:j + PLACED_ROWS])

    def counted(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    for is_home, (_, cell, ring) in places(pdf["vec"].to_numpy(), kind):
                        at, n = np.unique(np.stack((cell, ring), axis=1), axis=0, return_counts=True)
                        yield pd.DataFrame({"cell": at[:, 0], "ring": at[:, 1], "home": is_home, "n": n})

        return run

    sides = [(home, "both")] if guests is None else [(home, "home"), (guests, "guests")]
    sizes: dict[tuple[int, int, bool], int] = {}
    for df, kind in sides:  # as many rows as there are places, which pivots and rings bound
        for r in df.select("vec").mapInPandas(counted(kind), "cell int, ring int, home boolean, n long").groupBy(*_PLACE).agg(F.sum("n").alias("n")).collect():
            sizes[r.cell, r.ring, r.home] = r.n
    out = Meetings(home, sizes, block_rows, guests is not None)
    parts = {k: out.parts(k) for k in sizes}

    def placed(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    ids, vecs = pdf["id"].to_numpy(), pdf["vec"].to_numpy()
                    for is_home, (i, cell, ring) in places(vecs, kind):
                        n = np.array([parts[c, r, is_home] for c, r in zip(cell.tolist(), ring.tolist())], np.int64)
                        mixed = (ids[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                        yield pd.DataFrame({"cell": cell, "ring": ring, "home": is_home, "sub": (mixed.astype(np.int64) % np.maximum(n, 1)).astype("int32"), "id": ids[i], "vec": vecs[i]})

        return run

    schema = "cell int, ring int, home boolean, sub int, id long, vec array<double>"
    for df, kind in sides:
        part = df.mapInPandas(placed(kind), schema)
        out.placed = part if df is sides[0][0] else out.placed.unionByName(part)
    return out


def _one_cell(home: DataFrame, rows: int, guests: DataFrame | None, block_rows: int) -> Meetings:
    """All in one cell, dealt to blocks by a hash."""
    sizes = {(0, 0, True): rows} if rows else {}
    if guests is not None and rows:
        sizes[0, 0, False] = guests.count()
    out = Meetings(home, sizes, block_rows, guests is not None)
    for df, is_home in ((home, True), (guests, False)):
        if df is not None:
            part = df.select(F.lit(0).alias("cell"), F.lit(0).alias("ring"), F.lit(is_home).alias("home"), F.pmod(
                F.xxhash64("id"), F.lit(out.parts((0, 0, is_home)))).cast("int").alias("sub"), "id", "vec")
            out.placed = part if is_home else out.placed.unionByName(part)
    return out


def _pairs_of(a, b, same: bool, threshold: float) -> Iterator[tuple]:
    """Index pairs and similarities between two blocks, slice by slice; within one block each pair once.

    Single precision, with its widest error allowed for, tells where to look; doubles decide."""
    longest = [np.linalg.norm(x, axis=1).max() if len(x) else 0.0 for x in (a, b)]
    rough = all(1e-15 < x < 1e15 for x in longest)
    low = threshold - (a.shape[1] + 8) * 2.0 ** -23 * longest[0] * longest[1]
    a4, b4 = (a.astype("float32"), b.astype("float32")) if rough else (a, b)
    for at in range(0, len(a), SLICE_ROWS):
        x, got = a[at:at + SLICE_ROWS], []
        for bt in range(at // TILE_ROWS * TILE_ROWS if same else 0, len(b), TILE_ROWS):
            y = b[bt:bt + TILE_ROWS]
            hit = np.flatnonzero(a4[at:at + SLICE_ROWS] @ b4[bt:bt + TILE_ROWS].T >= low) if rough else None
            if rough and len(hit) <= FEW_HITS:
                i, j = np.divmod(hit, len(y))
                s = np.einsum("ij,ij->i", x[i], y[j])
            else:
                s = (x @ y.T).ravel()
                hit = np.flatnonzero(s >= threshold)
                i, j = np.divmod(hit, len(y))
                s = s[hit]
            ok = s >= threshold
            if same:
                ok &= i + at < j + bt
            got.append((i[ok] + at, j[ok] + bt, s[ok]))
        yield tuple(np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _stats_frame(hi, lo) -> pd.DataFrame:
    if len(hi) == 0:
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "first": pd.Series(dtype="int64"),
                             "degree": pd.Series(dtype="int64")})
    g = pd.DataFrame({"id": hi, "lo": lo}).groupby("id")["lo"].agg(["min", "size"]).reset_index()
    return g.rename(columns={"min": "first", "size": "degree"})


def _stats_of(slices: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """One row per id, out of (hi, lo) of all slices."""
    got = [g for g in (_stats_frame(hi, lo) for hi, lo in slices) if len(g)]
    if got:
        yield pd.concat(got).groupby("id", as_index=False).agg({"first": "min", "degree": "sum"})


def _both(pdf: pd.DataFrame) -> tuple:
    rows = list(pdf.sort_values("side").itertuples(index=False))
    return (*_unpack(rows[0]), *_unpack(rows[-1]), len(rows) == 1)


def near_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Pairs lo < hi of (id, vec) whose product reaches the threshold: lo, hi, sim."""

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ia, a, ib, b, same = _both(pdf)
        for i, j, s in _pairs_of(a, b, same, threshold):
            x, y = ia[i], ib[j]
            for at in range(0, len(s), PAIR_ROWS):
                piece = slice(at, at + PAIR_ROWS)
                yield pd.DataFrame({"lo": np.minimum(x[piece], y[piece]), "hi": np.maximum(x[piece], y[piece]), "sim": s[piece]})

    return meetings(vectors, threshold, block_rows, rows).run(meet, "lo long, hi long, sim double")


def _combine(stats: DataFrame) -> DataFrame:
    return stats.groupBy("id").agg(F.min("first").alias("first"), F.sum("degree").alias("degree"))


def earlier_neighbours(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, first, degree) of every vector with smaller-id neighbours. One row per vector and meeting
    of blocks at most, however many pairs pass: a crowd of near copies yields no crowd of pairs."""

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ia, a, ib, b, same = _both(pdf)
        yield from _stats_of((np.maximum(ia[i], ib[j]), np.minimum(ia[i], ib[j])) for i, j, _ in _pairs_of(a, b, same, threshold))

    return _combine(meetings(vectors, threshold, block_rows).run(meet, "id long, first long, degree long"))


def neighbours_among(vectors: DataFrame, leaders: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, first, degree) over the smaller-id leaders near to each vector. Leaders are at home in the cells."""

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        il, lead, iv, vec, _ = _both(pdf)
        yield from _stats_of((hi, lo) for lo, hi in _earlier(il, lead, iv, vec, threshold))

    return _combine(meetings(leaders, threshold, block_rows, guests=vectors).run(meet, "id long, first long, degree long"))


def _earlier(il, lead, iv, vec, threshold: float) -> Iterator[tuple]:
    """Ids of near ones (lo, hi), hi of the vectors and lo before it, slice by slice."""
    for i, j, _ in _pairs_of(vec, lead, False, threshold):
        lo, hi = il[j], iv[i]
        before = lo < hi
        yield lo[before], hi[before]


def earlier_pairs(vectors: DataFrame, some: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lo, hi of all near pairs lo < hi whose hi is among some of the vectors."""

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        il, lead, iv, vec, _ = _both(pdf)
        for lo, hi in _earlier(il, lead, iv, vec, threshold):
            for at in range(0, len(lo), PAIR_ROWS):
                yield pd.DataFrame({"lo": lo[at:at + PAIR_ROWS], "hi": hi[at:at + PAIR_ROWS]})

    return meetings(vectors, threshold, block_rows, guests=some).run(meet, "lo long, hi long")


def leader_clusters(
    vectors: DataFrame,
    threshold: float,
    block_rows: int = BLOCK_ROWS,
    direct_up_to: int = DIRECT_EDGES_UP_TO,
    edges_per_vector: int = EDGES_PER_VECTOR,
    edges_per_task: int = EDGES_PER_TASK,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """(id, leader) by cosine >= threshold, in id order.

    Equal vectors are clustered once. Few vectors: list the edges, elect leaders. Many: go through the ids in batches,
    each twice as large as the one before. A batch meets the leaders found so far, in the cells where near ones can be;
    whom they cover is settled, as no later leader comes first. Only the others meet one another. So the work is that of
    meeting leaders near by, and a crowd, once it has a leader, is not compared with itself.
    """
    digest = F.sha2(F.concat_ws(",", as_double("vec").cast("array<string>")), 256)
    vectors = vectors.select("id", as_double("vec").alias("vec"), digest.alias("digest"))
    first = cut_lineage(vectors.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")))
    n = first.count()
    if n <= direct_up_to:
        chosen = elect(first, cut_lineage(near_pairs(first, threshold, block_rows, n)), edges_per_task)
    else:
        chosen = _in_batches(first, n, threshold, block_rows, edges_per_vector, edges_per_task, batch_rows)
    # every copy of a vector goes where the first one went; only ids and digests move
    rep = first.select("id", "digest").join(chosen, "id").select("digest", "leader")
    return vectors.select("id", "digest").join(rep, "digest").select("id", "leader")


def _in_batches(first: DataFrame, n: int, threshold: float, block_rows: int, edges_per_vector: int, edges_per_task: int,
                batch_rows: int) -> DataFrame:
    ends, size = [], batch_rows
    while size < n:
        ends.append(size / n)
        size = 2 * size + batch_rows
    # any cut of the ids gives the same clusters
    cuts = sorted({int(c) for c in first.stat.approxQuantile("id", ends, 0.001)}) if ends else []
    leaders, settled = None, []
    for low, high in zip([None, *cuts], [*cuts, None]):
        rest = first
        rest = rest if low is None else rest.filter(F.col("id") > low)
        rest = rest if high is None else rest.filter(F.col("id") <= high)
        if leaders is not None:
            led = cut_lineage(neighbours_among(rest, leaders, threshold, block_rows).select("id", F.col("first").alias("leader")))
            settled.append(led)
            rest = cut_lineage(rest.join(led, "id", "left_anti"))
        chosen = cut_lineage(_peel(rest, threshold, block_rows, edges_per_vector, edges_per_task))
        settled.append(chosen)
        new = rest.join(chosen.filter("id = leader").select("id"), "id", "left_semi")
        leaders = cut_lineage(new if leaders is None else leaders.unionByName(new))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _peel(first: DataFrame, threshold: float, block_rows: int, edges_per_vector: int, edges_per_task: int) -> DataFrame:
    rest, leaders = first, []
    while True:
        stats = cut_lineage(earlier_neighbours(rest, threshold, block_rows))
        n_rest, n_edges = rest.count(), stats.agg(F.sum("degree")).first()[0] or 0
        if n_edges <= edges_per_vector * n_rest:
            ids = rest.select("id")
            if n_edges:
                # a single earlier neighbour is known; only who has more is compared again
                edges = stats.filter("degree = 1").select(F.col("first").alias("lo"), F.col("id").alias("hi"))
                several = stats.filter("degree > 1").select("id")
                if not several.isEmpty():
                    edges = edges.unionByName(earlier_pairs(rest, rest.join(several, "id", "left_semi"), threshold, block_rows))
                settled = elect(rest, cut_lineage(edges), edges_per_task)
                if not leaders:
                    return settled
                ids = settled.filter("id = leader").select("id")
            elif not leaders:
                return ids.select("id", F.col("id").alias("leader"))
            leaders.append(rest.join(ids, "id", "left_semi"))
            break
        lead = cut_lineage(rest.join(stats, "id", "left_anti"))
        leaders.append(lead)
        waiting = cut_lineage(rest.join(stats, "id", "left_semi"))
        led = neighbours_among(waiting, lead, threshold, block_rows)
        rest = cut_lineage(waiting.join(led, "id", "left_anti"))
    all_leaders = leaders[0]
    for more in leaders[1:]:
        all_leaders = all_leaders.unionByName(more)
    all_leaders = cut_lineage(all_leaders)
    others = first.join(all_leaders, "id", "left_anti")
    joined = neighbours_among(others, all_leaders, threshold, block_rows).select("id", F.col("first").alias("leader"))
    return all_leaders.select("id", F.col("id").alias("leader")).unionByName(joined)
