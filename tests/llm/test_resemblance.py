"""The near-duplicate stage against Jaccard by brute force."""

import random

import corpus_pipeline

from stackwarden.llm import resemblance, simhash

SCHEMA = "doc_id long, text string, k string"


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_ids(texts):
    sets = [plain_set(t) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and alike(sets[i], sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return sorted(set(least))


def planted(n_family=40):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(4, 250))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:
        for edits in (1, 2, 3, 5, 8):  # from well above 0.8 to well below
            w = list(b)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
    family = [rnd.choice(words) for _ in range(200)]
    for _ in range(n_family):
        w = list(family)
        for _ in range(rnd.randint(1, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return texts + [None, "", " ", "A B", "a b"]


def test_stage_keeps_one_of_each_jaccard_component(spark, tmp_path):
    texts = planted()
    want = kept_ids(texts)
    assert 40 < len(want) < len(texts) - 60
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == want


def test_rows_go_by_text_not_by_id(spark):
    t, u = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, t, "x"), (2, t, "copy"), (2, u, "only"), (None, t, "n"), (None, t, "n"), (None, "c d", "n"), (1, t, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = spark.createDataFrame([(1, t, "x"), (2, u, "only"), (None, t, "n"), (None, "c d", "n")], SCHEMA).collect()
    for operator in (resemblance, simhash):
        assert sorted(map(str, operator.keep_one(df).collect())) == sorted(map(str, want))
        assert operator.keep_one(df.limit(0)).count() == 0


def test_simhash_links_come_first(spark):
    t = [f"a{i}" for i in range(400)]
    near = [" ".join(t), " ".join(["x"] + t), " ".join(t + ["y"]), " ".join(f"b{i}" for i in range(400))]
    rows = resemblance._prepared(spark.createDataFrame([(i, x, "k") for i, x in enumerate(near)], SCHEMA), 5)
    node = {r.doc_id: r.node for r in rows.collect()}
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows.collect()}
    assert all((prints[0] ^ prints[i]).bit_count() <= simhash.RADIUS for i in (1, 2)) and (prints[0] ^ prints[3]).bit_count() > 3
    pairs = {frozenset((r.a, r.b)) for r in resemblance._close_prints(rows).collect()}
    assert pairs and {n for p in pairs for n in p} == {node[i] for i in (0, 1, 2)}


def test_few_rows_take_few_shuffles(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    shuffle = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffle()
    kept = sorted(r.doc_id for r in resemblance.keep_one(docs).collect())
    assert shuffle() - before < 80  # each leaves files for every partition
    assert kept == kept_ids(texts)


def test_a_shared_passage_makes_no_crowd_of_pairs(spark, monkeypatch):
    """300 texts of which two thirds are one passage share fingerprints, but are not alike; some have a near copy."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    passage = [rnd.choice(words) for _ in range(120)]
    own = [[rnd.choice(words) for _ in range(60)] for _ in range(300)]
    own += [[*w[:-1], "other"] for w in own[:40]]
    texts = [" ".join(passage + w) for w in own]
    asked, compare = [], resemblance._alike

    def counted(pairs, *more):
        asked.append(pairs.distinct().count())
        return compare(pairs, *more)

    monkeypatch.setattr(resemblance, "_alike", counted)
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in resemblance.keep_one(df).collect()) == kept_ids(texts)
    assert max(asked) < 20 * len(texts)  # of 170 * len(texts)
