"""Removal of repeats against brute force, and the merge by itself."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from stackwarden.llm import suffixes as S
from stackwarden.llm.queries import QUERIES


def brute(texts, length):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen[t[s:s + length]].append((d, s))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                out[d][s:s + length] = True
    return out


def some_texts(rnd):
    pool = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(30, 300))) for _ in range(6)]
    pool += ["ab" * rnd.randint(10, 200), "x" * rnd.randint(20, 300), "Et " * rnd.randint(30, 150), ("abcdefg" * 60)[:rnd.randint(50, 400)],
             "".join(rnd.choice("ab") for _ in range(200)), "漢字🙂" * rnd.randint(1, 60)]
    texts = []
    for _ in range(rnd.randint(1, 12)):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            x = rnd.choice(pool)
            i = rnd.randrange(len(x))
            t += x[i:rnd.randint(i, len(x))] if rnd.random() < 0.5 else x
            if rnd.random() < 0.4:
                t += "".join(rnd.choice("qwerty") for _ in range(rnd.randint(1, 60)))
        if rnd.random() < 0.3 and len(t) > 5:
            k = rnd.randrange(len(t))
            t = t[:k] + "!" + t[k + 1:]
        texts.append(t)
    return texts


def through_blocks(texts, length, n_blocks, buckets=3):
    blocks, keys = [], []
    for b in range(n_blocks):
        own = texts[b::n_blocks]
        raw, ends = b"".join(own), np.cumsum([len(t) for t in own]).astype(np.int64)
        blocks.append((raw, ends))
        anchors, _ = S.anchors_of(np.frombuffer(raw, np.uint8), ends, length)
        k, right, left = S.half_hashes(raw, anchors, length)
        keys.append(np.unique(np.concatenate((k[0, right], k[1, left]))))
    values, n = np.unique(np.concatenate(keys), return_counts=True)
    runs, own, answers = defaultdict(list), {}, defaultdict(list)
    for b, (raw, ends) in enumerate(blocks):
        for bucket, data in S.runs_of_block(raw, ends, np.intersect1d(keys[b], values[n > 1]), length, buckets):
            if bucket < 0:
                own[b] = data
            else:
                runs[bucket].append((b, data))
    for bucket, sent in runs.items():
        for (b, _), a in zip(sent, S.merge_bucket([r for _, r in sent], length)):
            answers[b].append((bucket, a))
    out = [None] * len(texts)
    for b, (raw, ends) in enumerate(blocks):
        gone = S.cut_block(raw, ends, own[b], answers[b], length)
        for i, part in zip(range(b, len(texts), n_blocks), np.split(gone, ends[:-1])):
            out[i] = part
    return out


def test_blocks_equal_brute_force(monkeypatch):
    rnd = random.Random(1)
    for _ in range(150):
        length = rnd.choice([64, 80, 100])
        texts = [t.encode() for t in some_texts(rnd)]
        monkeypatch.setattr(S, "SEGMENT", rnd.choice([1 << 20, 300, 700]))
        got = through_blocks(texts, length, min(len(texts), rnd.choice([1, 2, 3])))
        for a, b in zip(brute(texts, length), got):
            assert np.array_equal(a, b)


def test_loser_tree_merges_and_knows_prefixes():
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 16):
        runs = [sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))}) for _ in range(n)]
        coded = [S.front_decode(*S.front_code(r)) for r in runs]
        assert [c[1] for c in coded] == runs
        out = [(runs[k][i], lcp) for k, i, lcp in S.LoserTree(coded).merged()]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r)
        for (x, _), (y, lcp) in zip(out, out[1:]):
            assert lcp == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = [t * rnd.randint(1, 3) for _ in range(6) for t in some_texts(rnd)] + [None, "", "a" * 3000, "b" * 399, "b" * 400, "c" * 400, "c" * 400]
    rows = [(i, t, "row") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([(t or "").encode() for t in texts], 400)
    got = {r.doc_id: r for r in QUERIES["op5_suffixes"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        r, w = got[i], want[i]
        assert (r.n_bytes, r.n_removed) == (len(raw), int(w.sum()))
        assert r.n_spans == int((np.diff(np.concatenate(([0], w.view(np.int8)))) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(raw[~w].tobytes()).hexdigest()


def test_other_columns_stay_and_characters_stay_whole(spark):
    passage = "é" * 3 + "".join(random.Random(3).choice("abcdefé漢") for _ in range(500))
    rows = [(1, "x" + passage + "y", None, 1.5, "s"), (None, passage, "q", None, "s"), (2, "short", None, None, None), (2, "short", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts string, kept double, row string")
    for blocks in (10, 1 << 20):
        got = S.remove_repeats(df, 400, blocks).select("row.*", "text").collect()
        assert sorted(map(str, got)) == sorted(map(str, S.remove_repeats(df).select("row.*", "text").collect()))
        assert sorted(r.text for r in got) == ["", "short", "short", "xy"]
        assert {(r.doc_id, r.starts, r.kept, r.row) for r in got} == {(r[0], r[2], r[3], r[4]) for r in rows}
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_query_returns_the_kept_text_as_the_stage_does(spark, tmp_path):
    from stackwarden.llm.queries import op5_suffixes

    again = "".join(chr(0xE0 + i * i % 30) + str(i) for i in range(200))
    texts = ["d\u00e9j\u00e0 vu, na\u00efve", "one " + again, again + " two", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_suffixes(spark, str(tmp_path)).collect()}
    assert [got[i].text or "" for i in range(4)] == [texts[0], "one ", " two", ""]
    assert [got[i].n_removed for i in range(4)] == [0, len(again.encode()), len(again.encode()), 0]
    assert "n_kept" not in got[0]  # a number of bytes, beside texts counted in characters
