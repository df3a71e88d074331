"""Importance resampling against plain Python: every n-gram cut out and hashed by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from stackwarden.llm import importance
from stackwarden.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def buckets_of(text, orders, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, min_words=20, orders=(1, 1), buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, orders, buckets)[1])
    for text in target:
        t.update(buckets_of(text, orders, buckets)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, f = buckets_of(text, orders, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[:percent * len(enough) // 100]):
        r[5] = i + 1
    return rows


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "日本", "X9", "a" * 70]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ",", "  --", "\n"]) for _ in range(rnd.randint(0, 90))) for _ in range(150)]
    texts += [None, "", "!!! ...", "one", "a\0b", texts[3], texts[3], "long " * 300_000 + "end"]
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (5000, texts[2]), (5000, texts[2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, at int").repartition(5)


def values(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("orders,buckets", [((1, 1), 10_000), ((1, 3), 500), ((2, 2), 7)])
def test_resample_equals_brute_force(spark, orders, buckets):
    rows, target = corpus(), ["w1 w2 w3 w4", None, "ÉTÉ 日本 w9", "w1 w2 w1 w2"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(frame(spark, rows), t, percent=30, orders=orders, buckets=buckets)
    assert values(got) == sorted(map(tuple, brute(rows, target, 30, 20, orders, buckets)), key=repr)


def test_long_texts_are_scanned_in_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 16)
    got = importance.Prefixes()
    texts = [b"some words here and there and more of them, all counted", b"", b"  ", b"one two"]
    for t in texts:
        got.add(t)
    for n, (crc, runs) in zip((1, 2, 4), [next(got.features((n, n))) for n in (1, 2, 4)]):
        w = [t.translate(importance.SPACED).split() for t in texts]
        assert crc.tolist() == [zlib.crc32(b" ".join(x[i:i + n])) for x in w for i in range(len(x) - n + 1)]
        assert runs.tolist() == [max(0, len(x) - n + 1) for x in w]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    rows = [(1, "a " * 30), (2, None)]
    assert values(importance.resample(frame(spark, rows), none, percent=100)) == sorted(map(tuple, brute(rows, [], 100)), key=repr)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["op11_importance"](spark, str(tmp_path)).columns == ["doc_id", "n_features", "weight", "score", "rank"]
