"""Language ID and SimHash near-duplicates against brute force."""

import random
import zlib

import numpy as np
import xxhash

from stackwarden.llm import langid, simhash
from stackwarden.llm.queries import QUERIES
from stackwarden.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    least = list(range(len(fps)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                least[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(ids[i])
    return {m: min(g) for g in groups.values() for m in g}


def copies():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    out = base + base[:20] + [None, "", " ", "A B", "a b"]
    for t in base[:40]:
        w = t.split()
        for _ in range(4):
            w[rnd.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark, tmp_path):
    texts = copies()
    rows = [(i * 7 % 1009, t, "en", "s", "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string, k string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, str(tmp_path)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], fps)
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == {r[0]: f for r, f in zip(rows, fps)}
    assert {k: r.component_id for k, r in got.items()} == want
    kept = simhash.keep_one(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "k"]


def crowded(n, seed):
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    return sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 5, 9, 20]))) for _ in range(n)} | {rnd.getrandbits(64) for _ in range(n)})


def test_crowds_lose_no_link(spark, monkeypatch):
    fps = crowded(300, 1)
    ids = list(range(len(fps)))
    want = plain_components(ids, fps)
    monkeypatch.setattr(simhash, "CROWD", 16)
    a = np.array(fps, np.uint64)
    label = np.arange(len(a))
    for i, j in simhash.crowd_pairs(a):
        label = simhash.settle(len(a), np.concatenate((i, ids)), np.concatenate((j, label)))
    assert {i: int(label[i]) for i in ids} == want
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(5)
    edges = simhash.links(df)
    roots = {r.node: r.root for r in components(edges).collect()}
    signed = [int(x) for x in a.view(np.int64)]
    classes = {}
    for i, f in enumerate(signed):
        classes.setdefault(roots.get(f, f), set()).add(i)
    wanted = {}
    for i, w in want.items():
        wanted.setdefault(w, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_in_rounds_are_equal(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(-400, 400), rnd.randrange(-400, 400)) for _ in range(350)] + [(-(1 << 63), 5), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    made = [sorted(map(tuple, components(frame, n).collect())) for n in (0, 10_000)]
    assert made[0] == made[1] and len(made[0]) > 100


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string, gone string"
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "x"), (None, "a b c d", "y"), (3, None, "z"), (4, "", "z")], schema)
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(df).collect()) == [0, 1, 3]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    got = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_and_texts_without_letters(spark):
    en, de = "the quick brown fox and the lazy dog " * 20, "der schnelle braune fuchs und der faule hund " * 20
    rows = [(i, en, "en") for i in range(12)] + [(100 + i, de, "de") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.langs == ["de", "en"]
    ask = spark.createDataFrame([(1, en + de, "x"), (2, en, "x"), (3, "12 34 !?", "x"), (4, None, "x"), (5, "", "x"), (None, de, "x"), (6, "漢", "x"), (7, (en + de) * 60, "x")],
                                "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.predict(ask, model).collect()}
    assert set(got[1].langs.split(",")) == {"en", "de"} and 0.4 < got[1].score < 0.7 and set(got[7].langs.split(",")) == {"en", "de"}
    assert (got[2].lang_pred, got[2].langs) == ("en", "en") and got[None].lang_pred == "de"
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[6].lang_pred in ("en", "de")
    nothing = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(ask, nothing).collect()} == {"und"}
