import random
import re
import tracemalloc
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwarden import constants as K
from stackwarden.operators import duplicates, exemplars, filing, folder_match, keywords
from stackwarden.plans import filing as plan_filing

WORDS = "invoice invoce travel travels holiday holidya report reports bank banque photo photos garden gardens ab cd".split()


def words_of(s, k):
    return [w for w in re.split("[^a-z0-9]+", s.lower()) if len(w) >= k]


def alike(needle, words):
    return any(needle == w or (abs(len(w) - len(needle)) <= 2 and len(needle) >= 4 and SequenceMatcher(None, needle, w).ratio() >= 0.85) for w in words)


def expected(text, name, folders):
    """Folder match for one asset, folder by folder."""
    flat = [re.sub("[^a-z0-9]+", "", s.lower()) for s in (text, name)]
    per = [words_of(s, 3) for s in (text, name)]
    pool = per[0] + per[1] + [a + b for p in per for a, b in zip(p, p[1:])]
    best = None
    for folder, used in folders:
        extra = 0.05 if used >= 3 else 0.0
        for seg in filter(None, re.split(r"[/\\]", folder)):
            c = re.sub("[^a-z0-9]+", "", seg.lower())
            if len(c) < 4:
                continue
            hits = [c in f for f in flat]
            if any(hits):
                return folder, min(0.95, 0.80 + extra + (0.10 if all(hits) else 0.0))
            needles = words_of(seg, 4) or [c]
            share = sum(alike(n, pool) for n in needles) / len(needles)
            conf = 0.75 + extra if share >= 1 else 0.55 + 0.1 * share if share >= 0.6 and len(needles) >= 2 else None
            if conf and (best is None or conf > best[1]):
                best = folder, conf
    return best


@pytest.mark.parametrize("few", [256, 0])
def test_known_folders(spark, few):
    rnd = random.Random(4)
    pick = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    folders = sorted({f"{pick(rnd.randrange(1, 4))}{rnd.choice(['', '/' + pick(2), chr(92) + pick(1)])}" for _ in range(18)})
    used = {f: rnd.randrange(1, 6) for f in folders}
    order = sorted(folders, key=lambda f: (-used[f], folders.index(f)))
    files = [(i, pick(rnd.randrange(0, 5)), pick(2).replace(" ", "_") + f"_{i}.pdf") for i in range(120)]
    f = spark.createDataFrame([(x, used[x], folders.index(x)) for x in folders], "folder string, used_count long, first_seen long")
    a = spark.createDataFrame(files, "asset_id long, text string, filename string")
    got = {r.asset_id: (r.folder, round(r.confidence, 9)) for r in folder_match.match_known_folders(a, f, few).collect()}
    want = {i: (m[0], round(m[1], 9)) for i, t, n in files if (m := expected(t, n, [(x, used[x]) for x in order]))}
    assert got == want


def test_automaton_finds_what_anchors_and_literals_find(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 7)))
    names = sorted({"/".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(60)})
    f = spark.createDataFrame([(x, rnd.randrange(5), i) for i, x in enumerate(names)], "folder string, used_count long, first_seen long")
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 6))), word() + ".pdf") for i in range(200)] + [(900, None, "x"), (901, "", None)]
    a = spark.createDataFrame(texts, "asset_id int, text string, filename string")
    segs = folder_match.segments(f)
    rows = lambda df: sorted((r.asset_id, r.folder, round(r.confidence, 9)) for r in df.collect())
    got = folder_match.whole_name_matches(a, segs, 0)
    assert "(?=(" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(folder_match.whole_name_matches(a, segs)) == rows(folder_match.whole_name_matches(a, segs, 0, 0)) != []
    assert folder_match.whole_name_matches(a, segs.limit(0), -1).count() == 0


def test_a_hundred_thousand_folders(spark):
    f = spark.range(100_000).select(F.format_string("topic%05d/case file %05d", "id", F.lit(99_999) - F.col("id")).alias("folder"),
                                    (F.col("id") % 7).alias("used_count"), F.col("id").alias("first_seen"))
    a = spark.range(2_000).select(F.col("id").alias("asset_id"), F.concat(F.repeat(F.lit("some words before "), 20), F.format_string("Case-File %05d", F.col("id") * 40)).alias("text"),
                                  F.when(F.col("id") % 2 == 0, F.format_string("topic%05d.pdf", F.lit(99_999) - F.col("id") * 40)).otherwise("scan.pdf").alias("filename"))
    got = {r.asset_id: (r.folder, round(r.confidence, 2)) for r in folder_match.whole_name_matches(a, folder_match.segments(f)).collect()}
    for i in range(2_000):
        k = 99_999 - 40 * i
        assert got[i] == (f"topic{k:05d}/case file {40 * i:05d}", 0.85 if k % 7 >= 3 else 0.8)


def test_pieces_find_all_words_within_the_bound(spark):
    rnd = random.Random(8)
    needles = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 15))) for _ in range(40)]
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 16))) for _ in range(200)]
    for n in needles:  # misspelt ones
        w = list(n)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(["", "a", "bc"])
        words.append("".join(w))
    nd = spark.createDataFrame([(n,) for n in needles], "needle string")
    wd = spark.createDataFrame([(w,) for w in words if len(w) >= 3], "word string")
    want = {(n, w) for n in needles for w in words if len(w) >= 3 and alike(n, [w])}
    for few in (256, 0):
        assert {tuple(r) for r in folder_match.fuzzy_words(nd, wd, few).collect()} == want


def test_keyword_search_equals_plain_patterns(spark):
    texts = ["Mon IBAN et le solde", "ſolde", "les soldes", "TOTAL 12,50", "M15 chart", "m123", "Expérience  professionnelle", "diplomé", "xcontractx contract",
             "total due\u2028 12,50 eur", "total due\r12,50 eur", "total due\x85 12,50", "total due\n12,50 eur", "signalement", "n° facture", "date d'échéance", "conditions générales", "", "caisse d epargne", "vu a midi", "Recu 1", "KIBAN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.keyword_category for r in filing.with_keyword_category(df).collect()}
    for i, t in enumerate(texts):
        hits = {c: sum(bool(re.search(p, t.lower(), re.I)) for p in ps) for c, ps in K.KEYWORD_PATTERNS.items()}
        best = max(hits, key=hits.get)
        assert got[i] == (best if hits[best] else None), t


@pytest.mark.parametrize("top_n", [None, 3])
def test_blocks_score_as_the_broadcast_does(spark, top_n, monkeypatch):
    rnd = np.random.default_rng(1)
    unit = lambda n: [[float(x) for x in r / np.linalg.norm(r)] for r in rnd.normal(size=(n, 6))]
    store = spark.createDataFrame([(f"F{i % 9}", "image" if i % 2 else "text", i, v) for i, v in enumerate(unit(80))], "folder string, modality string, seq long, vec array<double>")
    q = spark.createDataFrame([(i // 2, "image" if i % 2 else "text", v) for i, v in enumerate(unit(60))], "asset_id long, modality string, vec array<double>")
    small = exemplars.folder_scores(q, store, top_n)
    monkeypatch.setattr(exemplars, "BLOCK_EXEMPLARS", 20)
    monkeypatch.setattr(exemplars, "BLOCK_QUERIES", 7)
    large = exemplars.folder_scores(q, store, top_n, broadcast_bytes=0)
    rows = lambda df: sorted((r.asset_id, r.modality, r.folder, round(r.score, 9)) for r in df.collect())
    assert rows(small) == rows(large) and small.count() > 0


def test_semantic_thresholds(spark):
    s = spark.createDataFrame([(1, "A", 0.71), (1, "B", 0.70), (2, "A", 0.50), (2, "B", 0.49), (3, "A", 0.50), (3, "B", 0.40), (4, "A", 0.36),
                               (5, "A", 0.36), (5, "B", 0.32), (6, "A", 0.34)], "asset_id long, folder string, score double")
    got = {r.asset_id: (r.reason, round(r.confidence, 6)) for r in exemplars.decide(s).collect()}
    assert got == {1: ("semantic_strong", 0.9065), 3: ("semantic_match", 0.705), 4: ("semantic_weak", 0.405)}


def test_cascade_prefers_names_only_when_meaning_is_not_certain(spark):
    rows = [(1, "Bank/X", 0.85, "Other/Y", 0.92), (2, "Bank/X", 0.85, "Other/Y", 0.93), (3, "Bank/X", 0.80, None, None), (4, "Bank/X", 0.80, "Other/Y", 0.5)]
    df = spark.createDataFrame(rows, "asset_id long, fuzzy_folder string, fuzzy_conf double, sem_folder string, sem_conf double")
    none = F.lit(None).cast("string")
    df = df.select("*", F.lit("/p").alias("path"), F.lit("pdf").alias("kind"), F.lit("semantic_match").alias("sem_reason"), none.alias("keyword_category"),
                   F.lit(False).alias("is_chart"), F.lit(None).cast("struct<category:string,folder:string,confidence:double>").alias("hint"),
                   none.alias("rule_keyword"), none.alias("rule_chart"), none.alias("rule_hint"))
    assert {r.asset_id: r.category for r in filing.cascade(df).collect()} == {1: "Bank", 2: "Other", 3: "Bank", 4: "Other"}


@pytest.mark.parametrize("top_n", [None, 3])
@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_a_folder_with_a_third_of_all_examples_is_split(spark, top_n, limit, monkeypatch):
    monkeypatch.setattr(exemplars, "BLOCK_EXEMPLARS", 60)
    monkeypatch.setattr(exemplars, "BLOCK_QUERIES", 16)
    rnd = np.random.default_rng(7)
    unit = lambda n: [[float(x) for x in r / np.linalg.norm(r)] for r in rnd.normal(size=(n, 5))]
    store = [("big" if i % 3 == 0 else f"f{i % 40:02d}", "image", i % 50, v) for i, v in enumerate(unit(900))]
    asks = [(i, "image", v) for i, v in enumerate(unit(40))]
    s = spark.createDataFrame(store, "folder string, modality string, seq long, vec array<double>")
    q = spark.createDataFrame(asks, "asset_id long, modality string, vec array<double>")
    plain = exemplars.folder_scores(q, s, None, slice_rows=10**6).collect()
    want = sorted((r.asset_id, -round(r.score, 9), r.folder) for r in plain)
    if top_n:
        want = sorted(x for a in range(40) for x in [w for w in want if w[0] == a][:top_n])
    got = exemplars.folder_scores(q, s, top_n, broadcast_bytes=limit, slice_rows=25)
    assert sorted((r.asset_id, -round(r.score, 9), r.folder) for r in got.collect()) == want
    # no folder has more rows in a block than its slices allow
    sliced = exemplars._with_slice(s, ["folder", "modality"], 25)
    sizes = [r["count"] for r in sliced.groupBy("folder", "slice").count().collect()]
    assert max(sizes) < 60 and sliced.filter("folder = 'big'").select("slice").distinct().count() == 12
    both = exemplars.combined_scores(q, s, top_n, limit, slice_rows=25).collect()
    assert sorted((r.asset_id, -round(r.score / 0.85, 9), r.folder) for r in both) == want


def test_cones_skip_folders_that_cannot_be_among_the_best():
    rnd = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    families = np.repeat(unit(rnd.normal(size=(12, 32))), 5, axis=0)
    mids = unit(families + 0.04 * rnd.normal(size=(60, 32)))
    mat = np.concatenate([unit(m + 0.05 * rnd.normal(size=(40, 32))) for m in mids])
    starts = np.arange(0, len(mat), 40)
    cents = unit(np.add.reduceat(mat, starts, axis=0))
    side = exemplars.Side([f"f{i:02d}" for i in range(60)], starts, mat, cents)
    q = unit(mids[rnd.integers(0, 60, 3000)] + 0.05 * rnd.normal(size=(3000, 32)))
    for scale in (1.0, 0.3, 7.0):
        done = []
        some, full = exemplars._best_blend(scale * q, side, 2, done), exemplars._blend(scale * q, side)
        best = np.argsort(-full, axis=1, kind="stable")[:, :2]
        assert np.allclose(np.take_along_axis(some, best, axis=1), np.take_along_axis(full, best, axis=1))
        assert sum(a for a, _ in done) < 0.35 * sum(b for _, b in done)


def test_cones_are_exact_for_vectors_of_any_length():
    rnd = np.random.default_rng(10)
    for _ in range(40):
        n = rnd.integers(2, 30)
        sizes = rnd.integers(1, 9, n)
        starts = np.cumsum(sizes) - sizes
        mat = rnd.normal(size=(sizes.sum(), 3)) * rnd.choice([0.0, 0.1, 5.0], size=(sizes.sum(), 1))
        side = exemplars.Side(list(range(n)), starts, mat, rnd.normal(size=(n, 3)))
        q = rnd.normal(size=(300, 3)) * rnd.choice([0.0, 1.0, 3.0], size=(300, 1))
        some, full = exemplars._best_blend(q, side, 2), exemplars._blend(q, side)
        best = np.argsort(-full, axis=1, kind="stable")[:, :2]
        assert np.allclose(np.take_along_axis(some, best, axis=1), np.take_along_axis(full, best, axis=1))


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_combined_scores_leave_no_folder_out(spark, limit, monkeypatch):
    monkeypatch.setattr(exemplars, "BLOCK_EXEMPLARS", 40)
    monkeypatch.setattr(exemplars, "BLOCK_QUERIES", 7)
    rnd = np.random.default_rng(3)
    unit = lambda n: [[float(x) for x in r / np.linalg.norm(r)] for r in rnd.normal(size=(n, 6))]
    store = [(f"f{i % 45:02d}", m, i, v) for m in ("image", "text") for i, v in enumerate(unit(150)) if not (m == "text" and i % 45 > 40)]
    asks = [(i, m, v) for m in ("image", "text") for i, v in enumerate(unit(20)) if not (m == "image" and i == 3)]
    one = {}
    for a, m, q in asks:
        for f in {s[0] for s in store if s[1] == m}:
            vs = np.array([s[3] for s in store if s[0] == f and s[1] == m])
            c = vs.mean(axis=0)
            one[a, f, m] = 0.6 * (vs @ q).max() + 0.4 * float(c / np.linalg.norm(c) @ q)
    want = {}
    for a, f in {(a, f) for a, f, _ in one}:
        i, t = one.get((a, f, "image")), one.get((a, f, "text"))
        want[a, f] = 0.85 * t if i is None else 0.85 * i if t is None else 0.55 * i + 0.45 * t
    s = spark.createDataFrame(store, "folder string, modality string, seq long, vec array<double>")
    q = spark.createDataFrame(asks, "asset_id long, modality string, vec array<double>")
    got = {(r.asset_id, r.folder): r.score for r in exemplars.combined_scores(q, s, None, limit).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    best = exemplars.combined_scores(q, s, 2, limit).collect()
    for a in range(20):
        mine = sorted((-v, f) for (x, f), v in want.items() if x == a)[:2]
        assert [f for _, f in sorted((-r.score, r.folder) for r in best if r.asset_id == a)] == [f for _, f in mine]


def test_tags_of_any_number_and_length(spark):
    tags = spark.createDataFrame([("a" * 1500, 100001, [1.0, 0.0]), ("alpha", 99999, [0.0, 1.0])], "tag string, tag_ord int, vec array<double>")
    images = spark.createDataFrame([(1, [1.0, 0.0])], "asset_id long, vec array<double>")
    got = {(r.tag, r.tag_ord) for r in keywords.tag_scores(images, tags).collect()}
    assert got == {("a" * 1500, 100001), ("alpha", 99999)}


def test_bytes_and_texts_stay_out_of_groups(spark):
    assets = spark.createDataFrame([(1, "/a", 2000, "x", bytearray(b"q"))], "asset_id long, path string, size long, text string, content binary").withColumn("mtime", F.current_timestamp())
    cache = spark.createDataFrame([], "fingerprint string")

    def encoder(batches):
        yield from ()

    for df in (duplicates.confirm_bytes(assets), plan_filing.enrich_missing(assets, cache, encoder)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if re.search(r"HashAggregate|SortAggregate|Sort ", line):
                assert "content" not in line and "text#" not in line, line


def test_candidate_tags_are_encoded_in_order(spark):
    def encoder(batches):
        for b in batches:
            assert all(x == "a photo of " + t for x, t in zip(b["model_input"], b["tag"]))
            yield b[["tag", "tag_ord"]].assign(vec=[[float(i)] for i in b["tag_ord"]])

    got = plan_filing.tag_vectors(spark, encoder).orderBy("tag_ord").collect()
    assert [r.tag for r in got] == list(K.TAGS) and [r.vec for r in got] == [[float(i)] for i in range(len(K.TAGS))]


def test_keyword_search_of_ascii_skips_what_it_can_and_finds_the_same(spark):
    patterns = [p for pats in K.KEYWORD_PATTERNS.values() for p in pats]
    assert [p for p in patterns if filing._needed_words(p) is None] == [r"\b[mh]\d{1,2}\b\s*(?:timeframe)?"]
    assert filing._needed_words(r"\b(vu a|seen at)\b") == ["vu a", "seen at"]
    rng = random.Random(3)
    bits = ["ht", "pips", "pip", "stop", "loss", "take", "profit", "h1", "m15", "h123", "online", "seen at", "term of agreement", "term of the ",
            "agreement", "diplomé", "diplome", "invoice no", "invoice", "#", "montant total", "total 12,50", "ſkills", "skills",
            "ſolde", "syntheſe", "n° facture", "du contrat", "durée du contrat", "date d'échéance", "rib", "iban"]
    glue = ["", " ", "_", "é", "ſ", "a", "7", ".", "\n", " ", "٣"]
    texts = ["".join(rng.choice(glue) + rng.choice(bits) for _ in range(rng.randint(1, 4))) + rng.choice(glue) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    whole = F.struct(*[F.col("t").rlike("(?d)" + filing._in_ascii(p)).alias(f"p{i}") for i, p in enumerate(patterns)])
    quick = F.struct(*[filing._search(F.col("t"), p, ascii_only=True).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = df.select("t", whole.alias("a"), quick.alias("b")).collect()
    assert not [r.t for r in rows if r.a != r.b]
    assert sum(map(sum, (r.a for r in rows))) > 300


def test_scores_are_made_in_tiles():
    """A block of queries against a block of examples would be 256 MiB of products."""
    rnd = np.random.default_rng(11)
    mat, q = rnd.normal(size=(8192, 4)), rnd.normal(size=(4096, 4))
    side = exemplars.Side(["a", "b"], np.array([0, 5000]), mat, rnd.normal(size=(2, 4)))
    tracemalloc.start()
    got = exemplars._blend(q, side)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    best = np.stack([(q[::500] @ mat[:5000].T).max(axis=1), (q[::500] @ mat[5000:].T).max(axis=1)], axis=1)
    assert np.allclose(got[::500], 0.6 * best + 0.4 * (q[::500] @ side.cents.T))


def test_a_large_store_is_broadcast_in_shares_and_nothing_is_shuffled_to_meet(spark, monkeypatch):
    monkeypatch.setattr(exemplars, "BLOCK_EXEMPLARS", 60)
    rnd = np.random.default_rng(12)
    rows = lambda n: [[float(x) for x in r] for r in rnd.normal(size=(n, 5))]
    s = spark.createDataFrame([(f"f{i % 11}", "text" if i % 3 else "image", i, v) for i, v in enumerate(rows(700))], "folder string, modality string, seq long, vec array<double>")
    q = spark.createDataFrame([(i // 2, "image" if i % 2 else "text", v) for i, v in enumerate(rows(50))], "asset_id long, modality string, vec array<double>")
    held, real = [], exemplars._shares
    monkeypatch.setattr(exemplars, "_shares", lambda sizes, most: held.append(([n for _, _, n in sizes], most, got := real(sizes, most))) or got)
    part = exemplars.combined_scores(q, s, 2, 200 * 8 * 5, slice_rows=40)
    sizes, most, shares = held[0]
    assert most == 200 and sorted(b for x in shares for b in x) == sorted({b for x in shares for b in x}) and len(shares) > 3 and sum(map(len, shares)) == len(sizes)
    assert "CoGroup" not in part._jdf.queryExecution().executedPlan().toString()
    as_rows = lambda df: sorted((r.asset_id, r.folder, round(r.score, 9)) for r in df.collect())
    assert as_rows(part) == as_rows(exemplars.combined_scores(q, s, 2)) and part.count() == 50


def test_shares_hold_so_many_rows_or_one_block():
    sizes = [("b", 0, 5), ("a", 2, 4), ("a", 1, 6), ("a", 0, 30), ("b", 1, 5)]
    assert exemplars._shares(sizes, 10) == [[("a", 0)], [("a", 1), ("a", 2)], [("b", 0), ("b", 1)]]
    assert exemplars._shares([], 10) == [] and all(len(x) == 1 for x in exemplars._shares(sizes, 0))
