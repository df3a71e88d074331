"""Repeated passages counted in words against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np

from test_suffixes import brute


def brute_words(texts, n):
    seen, out = defaultdict(list), [np.zeros(len(t), bool) for t in texts]
    for d, t in enumerate(texts):
        spans, at = [], 0
        for w in t.split():
            at = t.index(w, at)
            spans.append((at, at + len(w)))
            at += len(w)
        for i in range(len(spans) - n + 1):
            seen[t[spans[i][0]:spans[i + n - 1][1]]].append((d, spans[i][0], spans[i + n - 1][1]))
    for places in seen.values():
        if len(places) > 1:
            for d, s, e in places:
                out[d][s:e] = True
    return out


def planted():
    rnd = random.Random(9)
    word = lambda k: "".join(rnd.choice("abcdefghijé") for _ in range(k))
    fill = lambda: " ".join(word(rnd.randint(1, 9)) for _ in range(rnd.randint(20, 120)))
    texts = [fill() for _ in range(6)]
    for n, k in ((51, 1), (51, 4), (52, 5), (65, 5), (50, 5), (50, 6), (30, 12), (90, 6)):
        passage = "\n".join(word(rnd.randint(k, k + 1)) for _ in range(n))
        texts += [f"{fill()} {passage} {fill()}" for _ in range(2)]
    twin = " ".join(word(4) for _ in range(55))
    return texts + [f"{fill()}\t{twin} {fill()} {twin}", "no " * 60, "x", None, "", twin + "s"]


def test_passages_of_51_words_go(spark, tmp_path):
    texts = planted()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(4)
    raw = [(t or "").encode() for t in texts]
    by_bytes, by_words = brute(raw, 400), brute_words(raw, 51)
    assert sum(int((w & ~b).sum()) for w, b in zip(by_words, by_bytes)) > 1000
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, df, str(tmp_path)).collect()}
    for i, t in enumerate(raw):
        kept = np.frombuffer(t, np.uint8)[~(by_bytes[i] | by_words[i])].tobytes()
        assert got[i] == kept.decode(), i
