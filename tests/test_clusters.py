import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwarden.operators import cosine, hamming, images, leaders


def lead_in_order(ids, near):
    found, out = [], {}
    for j in sorted(ids):
        out[j] = next((i for i in found if near(i, j)), j)
        if out[j] == j:
            found.append(j)
    return out


@pytest.mark.parametrize("per_task", [0, 10, 1_000_000])
def test_election_equals_the_sequential_rule(spark, per_task):
    rnd = random.Random(per_task)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(130)}
    edges |= {(i, i + 1) for i in range(60, 80)}  # a chain
    e = spark.createDataFrame(sorted(edges), "lo long, hi long")
    got = {r.id: r.leader for r in leaders.elect(spark.range(90), e, edges_per_task=per_task).collect()}
    assert got == lead_in_order(range(90), lambda i, j: (i, j) in edges)


def _codes(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(12)]
    out = {}
    for i in range(n):
        c = rnd.choice(base)
        if i % 2:  # a crowd that shares its upper half
            c = (base[0] >> 32 << 32) | rnd.getrandbits(32) & 0x0F0F0F0F
        for _ in range(rnd.randrange(4)):
            c ^= 1 << rnd.randrange(64)
        out[i] = (c - (1 << 64) if c >= 1 << 63 else c, rnd.choice([2, 3]))
    return out


@pytest.mark.parametrize("max_bucket,wide_from", [(4096, 1_000_000), (4, 1_000_000), (4, 10)])
def test_no_pair_is_missed_or_doubled(spark, max_bucket, wide_from):
    codes = _codes(250, max_bucket)
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in codes.items()], "id long, code long, radius int")
    got = sorted((r.lo, r.hi, r.distance) for r in hamming.radius_pairs(df, max_bucket, wide_from).collect())
    want = sorted((i, j, d) for i in codes for j in codes if i < j
                  for d in [bin((codes[i][0] ^ codes[j][0]) % (1 << 64)).count("1")] if d <= codes[j][1])
    assert got == want and len(want) > 50


def test_hash_clusters(spark):
    codes = _codes(200, 9)
    codes |= {200 + i: codes[i % 7] for i in range(40)}  # plain copies
    df = spark.createDataFrame([(i, f"/p{i}", 1, c, r) for i, (c, r) in codes.items()], "asset_id long, path string, size int, a_hash long, radius int")
    got = {r.asset_id: r.group_id for r in images.hash_clusters(df, max_bucket=8).collect()}
    assert got == lead_in_order(codes, lambda i, j: bin((codes[i][0] ^ codes[j][0]) % (1 << 64)).count("1") <= codes[j][1])


def test_a_ball_of_codes_is_never_listed_as_pairs(spark, monkeypatch):
    """2,000 codes within three bits of one another's centre, and some far away: no step writes more rows than codes."""
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    ball = {centre}
    while len(ball) < 2000:
        ball.add(centre ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(1, 3))) ^ (1 << rnd.randrange(64) if rnd.random() < 0.1 else 0))
        if len(ball) > 1300 and rnd.random() < 0.5:
            ball.add(rnd.getrandbits(64))
    order = list(ball)
    rnd.shuffle(order)
    codes = [c - (1 << 64) if c >> 63 else c for c in order]
    written = []
    cut = images.cut_lineage
    monkeypatch.setattr(images, "cut_lineage", lambda df: (lambda out: written.append(out.count()) or out)(cut(df)))
    df = spark.createDataFrame([(i, f"/p{i}", 1, c, 2 + i % 2) for i, c in enumerate(codes)], "asset_id long, path string, size int, a_hash long, radius int")
    got = {r.asset_id: r.group_id for r in images.hash_clusters(df, batch_rows=100, pairs_per_code=4, max_bucket=256).collect()}
    n = len(order)
    assert got == lead_in_order(range(n), lambda i, j: (order[i] ^ order[j]).bit_count() <= 2 + j % 2)
    pairs = sum((order[i] ^ order[j]).bit_count() <= 2 + j % 2 for j in range(n) for i in range(j))
    assert pairs > 20 * n and max(written) <= 100 * 99 // 2


def _vectors(n, dim=8):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(6, dim))
    v = centre[rnd.integers(0, 6, n)] + 0.35 * rnd.normal(size=(n, dim))
    v[n // 2:n // 2 + n // 5] = v[5]  # many equal ones
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("kw", [
    {}, {"block_rows": 30}, {"block_rows": 30, "direct_up_to": 0, "edges_per_vector": 0},
    {"block_rows": 40, "direct_up_to": 0, "edges_per_vector": 3, "edges_per_task": 0},
    {"block_rows": 16, "direct_up_to": 0, "batch_rows": 40},
])
def test_cosine_clusters_equal_the_sequential_rule(spark, kw):
    v = _vectors(150)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    got = {r.id: r.leader for r in cosine.leader_clusters(df, 0.8, **kw).collect()}
    assert got == lead_in_order(range(150), lambda i, j: float(v[i] @ v[j]) >= 0.8)


def test_pairs_in_blocks(spark):
    v = _vectors(90)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    got = sorted((r.lo, r.hi) for r in cosine.near_pairs(df, 0.7, block_rows=20).collect())
    assert got == [(i, j) for i in range(90) for j in range(i + 1, 90) if float(v[i] @ v[j]) >= 0.7]


@pytest.mark.parametrize("threshold,scale", [(0.9, 1.0), (0.6, 1.0), (0.2, 1.0), (0.0, 1.0), (-0.5, 1.0), (2.0, 2.0), (0.05, 0.5)])
def test_pairs_by_cells_equal_brute_force(spark, threshold, scale):
    """With many cells, rings and split blocks; vectors of several lengths, zeros among them."""
    rnd = np.random.default_rng(8)
    v = _vectors(240, 5) * scale * rnd.choice([0.0, 0.6, 1.0], size=(240, 1), p=[0.02, 0.3, 0.68])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    got = sorted((r.lo, r.hi) for r in cosine.near_pairs(df, threshold, block_rows=16).collect())
    sims = v @ v.T
    sure = [(i, j) for i in range(240) for j in range(i + 1, 240) if sims[i, j] >= threshold + 1e-12]
    assert len(got) == len(set(got)) and set(sure) <= set(got) and all(sims[p] >= threshold - 1e-12 for p in got)


def test_cells_save_most_products_on_clustered_vectors(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(80, 24))
    v = centre[rnd.integers(0, 80, 6000)] + 0.2 * rnd.normal(size=(6000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    m = cosine.meetings(df, 0.9, 200)
    assert m.products < 0.25 * 6000 * 6000 / 2
    assert max(m.sizes[k] / m.parts(k) for k in m.sizes) <= 200
    got = {(r.lo, r.hi) for r in cosine.near_pairs(df, 0.9, 200).collect()}
    i, j = np.nonzero(np.triu(v @ v.T >= 0.9, 1))
    assert got == set(zip(i.tolist(), j.tolist()))


def test_vectors_without_clusters_are_sent_once_per_block(spark):
    """Such vectors would visit every cell: they stay in one cell of wide blocks, with the same pairs and leaders."""
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(2000, 32))
    v[::10] = v[1::10] + 0.1 * rnd.normal(size=(200, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    m = cosine.meetings(df, 0.78, 100)
    assert m.placed.count() == 2000 and len(m.sizes) == 1 and m.block_rows == cosine.WIDE * 100
    near = v @ v.T >= 0.78
    got = {(r.lo, r.hi) for r in cosine.near_pairs(df, 0.78, 100).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))))) and len(got) >= 200
    some = {(r.lo, r.hi) for r in cosine.earlier_pairs(df, df.filter("id % 20 = 1"), 0.78, 100).collect()}
    assert some == {p for p in got if p[1] % 20 == 1} and some


def test_leaders_in_batches_do_not_compare_crowds(spark, monkeypatch):
    """3,000 vectors in 12 crowds: after the first batch nearly all are covered by a leader there is."""
    rnd = np.random.default_rng(6)
    centre = rnd.normal(size=(12, 16))
    v = centre[rnd.integers(0, 12, 3000)] + 0.05 * rnd.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    done = []
    run = cosine.Meetings.run
    monkeypatch.setattr(cosine.Meetings, "run", lambda self, *a: done.append(self.products) or run(self, *a))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    got = {r.id: r.leader for r in cosine.leader_clusters(df, 0.9, 200, direct_up_to=0, batch_rows=100).collect()}
    near = v @ v.T >= 0.9
    assert got == lead_in_order(range(3000), lambda i, j: bool(near[i, j]))
    assert sum(done) < 0.05 * 3000 * 3000 / 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    assert cosine.near_pairs(none, 0.5).count() == 0 and cosine.neighbours_among(one, none, 0.5).count() == 0
    assert [tuple(r) for r in cosine.leader_clusters(one, 0.5).collect()] == [(1, 1)] and cosine.leader_clusters(none, 0.5).count() == 0


def test_guests_meet_leaders_by_cells(spark):
    v = _vectors(300, 5)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    lead = df.filter("id % 3 = 0")
    got = {r.id: (r["first"], r.degree) for r in cosine.neighbours_among(df, lead, 0.8, block_rows=16).collect()}
    want = {}
    for i in range(300):
        near = [j for j in range(0, i, 3) if v[i] @ v[j] >= 0.8]
        if near:
            want[i] = (near[0], len(near))
    assert got == want


def test_hamming_plan_has_no_cross_join(spark):
    df = spark.range(100).select("id", F.xxhash64("id").alias("code"), F.lit(3).alias("radius"))
    plan = hamming.radius_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains of 3,000 links, some with side branches: by rounds alone each would take 1,500."""
    rounds = []
    cut = leaders.cut_lineage
    monkeypatch.setattr(leaders, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    edges = [(c * 10_000 + i, c * 10_000 + i + 1) for c in range(3) for i in range(3000)] + [(5, 7), (20_001, 20_050)]
    df = spark.createDataFrame(edges, "lo long, hi long")
    got = {r.id for r in leaders.covered_items(df, edges_per_task=4000).collect()}
    want = set()
    for lo, hi in sorted(edges, key=lambda e: (e[1], e[0])):
        if lo not in want:
            want.add(hi)
    assert got == want and len(rounds) < 12


def test_blocks_meet_in_slices():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3 * cosine.SLICE_ROWS // 2, 8))
    for b, same in ((a, True), (rng.normal(size=(700, 8)), False)):
        slices = list(cosine._pairs_of(a, b, same, 2.0))
        assert len(slices) == 2 and all(len(np.unique(i)) <= cosine.SLICE_ROWS for i, _, _ in slices)
        hit = a @ b.T >= 2.0
        want = {(i, j) for i, j in np.argwhere(np.triu(hit, 1) if same else hit).tolist()}
        got = [(i, j) for x, y, _ in slices for i, j in zip(x.tolist(), y.tolist())]
        assert len(got) == len(want) and set(got) == want
