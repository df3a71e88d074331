"""Spelling variants against plain Python: all pairs of words compared."""

import random
import re
import zlib
from collections import Counter

import pytest

from stackwarden.llm import spelling
from stackwarden.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def values(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def edited(rnd, w, letters):
    i = rnd.randrange(len(w))
    return rnd.choice([w[:i] + rnd.choice(letters) + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1:]])


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abcé", 2), ("abcdefghijklmnopqrstuvwxyzßø", 3)])
def test_near_words_equal_brute_force(spark, letters, seed):
    """Two letters only: hardly any gram is rare, and words repeat their grams."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 14))) for _ in range(60)]
    words = set(base) | {edited(rnd, w, letters) for w in base for _ in range(4)}
    n = {w: rnd.choice([2, 3, 25, 40, 500, 6000]) for w in words if len(w) >= 7}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert values(got) == brute(n)


def test_pivots_are_the_rarest_disjoint_grams_of_the_prefix():
    rnd = random.Random(4)
    for _ in range(500):
        ranks = [rnd.randrange(6) for _ in range(rnd.randint(6, 12))]
        places, own, last = spelling.prefix_of(ranks)
        order = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
        assert places[:own] == order[:3] and places == order[:len(places)] and len(places) <= 5
        got = spelling.pivots_of(sorted(places[:own]), ranks)
        want = min(ranks[p] + ranks[q] for p in places[:own] for q in places[:own] if q >= p + 2)
        assert len(got) == 2 and got[1] - got[0] >= 2 and set(got) <= set(places[:own])
        assert sum(ranks[p] for p in got) == want


def test_query_over_texts_of_all_kinds(spark, tmp_path):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 10))) for _ in range(80)]
    texts = [" ".join(rnd.choice([w.upper(), w, w + "9", w + "āx"]) for w in rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "x" * 100_000, "x" * 100_000, texts[0], texts[0], "Größenwahn größenwahn GRÖßENWAHN", "frequent " * 50_000]
    rows = [(i, t, "n", 0) for i, t in enumerate(texts)] + [(None, texts[1], "n", 0), (3, texts[3], "n", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert values(QUERIES["op12_spelling"](spark, str(tmp_path))) == brute(counted([r[:2] for r in rows]))


def test_chains_are_followed_to_the_end(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "zzzzzzzz": 5}
    got = {r[0]: r[2] for r in values(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))}
    assert got == {w: "zzzzzzzz" if w[0] == "z" else "abcdefghijk" for w in n}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none, spelling.planted)).count() == 0
