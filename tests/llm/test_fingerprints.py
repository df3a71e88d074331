"""Document fingerprints against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from stackwarden.llm import fingerprints as fp


def texts():
    rnd = random.Random(4)
    words = [f"w{i}é" for i in range(300)] + ["漢🙂", "İ"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150))) for _ in range(120)]
    return out + out[:10] + [None, "", " ", "one", "x" * 300]


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_edited_texts_and_likeness(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ts = texts()
        rows = [(i * 3, t, 0, "r") for i, t in enumerate(ts)]
        got = {r.doc_id: r for r in fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string, n long, r string").repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == len(ts)
    by_text, prints = {}, {}
    for i, (k, t, *_) in enumerate(rows):
        r, t = got[k], t or ""
        after = ts[(i + 1) % len(ts)] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        prints[k] = int(r.fingerprint, 16)
        if edited == t:
            assert r.near_edited == 1
    for i, (k, *_) in enumerate(rows):
        nxt = got[rows[(i + 1) % len(rows)][0]]
        assert (got[k].near_next == 1) == (got[k].fingerprint == nxt.fingerprint)
        near = sum((prints[k] ^ v).bit_count() <= fp.RADIUS for v in prints.values())
        assert got[k].n_near == (near if k % 20 == 0 else None)
    long = [r for r in got.values() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.95


def test_votes_equal_plain_counting(spark):
    text = "a bb ccc dddd a bb ccc eeeeeeeeeeee"
    words = text.split()
    seen = Counter()
    total = 0
    for i, w in enumerate(words):
        seed = xxhash.xxh64_intdigest(w.encode(), 42)
        h = xxhash.xxh64_intdigest(words[i + 1].encode(), seed) if i + 1 < len(words) else seed
        signed = h
        h2 = xxhash.xxh64_intdigest(signed.to_bytes(8, "little"), 42)
        weight = min(len(w), fp.MAX_WEIGHT)
        total += weight
        for b in range(64):
            seen[b] += weight * (h >> b & 1)
            seen[64 + b] += weight * (h2 >> b & 1)
    want = sum(1 << b for b in range(128) if 2 * seen[b] > total)
    got = fp.compare_with_next(spark.createDataFrame([(20, text)], "doc_id long, text string")).first()
    assert int(got.fingerprint, 16) == want and got.n_near == 1 and got.near_next == 1


def test_search_equals_brute_force(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(128) for _ in range(30)]
    prints = sorted({b ^ sum(1 << x for x in rnd.sample(range(128), rnd.randint(0, 6))) for b in base for _ in range(30)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p & (1 << 64) - 1), signed(p >> 64), 1 + p % 3) for p in prints], "lo long, hi long, n long")
    for radius in (0, 3, 5):
        got = {(r.lo, r.hi): r.n_near for r in fp.search(df.filter(F.col("n") == 1), df, radius).collect()}
        for p in prints:
            if p % 3 == 0:
                assert got[signed(p & (1 << 64) - 1), signed(p >> 64)] == sum(1 + q % 3 for q in prints if (p ^ q).bit_count() <= radius)


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "b b"), (None, "a a"), (1, "c c"), (1, "c c"), (1, None)], "doc_id long, text string")
    got = sorted(fp.compare_with_next(df).collect(), key=lambda r: (r.doc_id or 0, r.n_chars, r.edited_sha256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {sha("a b"), sha("b ")}
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 1) == sorted([sha(""), sha("c c"), sha("c a")])
    assert fp.compare_with_next(df.limit(0)).count() == 0
