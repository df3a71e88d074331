"""Language ID against plain loops: counts by dictionary, every set of languages tried."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

from stackwarden.llm import langid
from stackwarden.llm.queries import QUERIES

ROUNDS = langid.EM_ROUNDS


def fourgrams(text):
    raw = b"  " + text.lower().encode() + b"  "
    out = []
    for i in range(len(raw) - 3):
        x = int.from_bytes(raw[i:i + 4], "little")
        out.append((x * 2654435761 % (1 << 32)) >> 17)
    return out


def likelihood(g, probs):
    """Plain expectation-maximisation of the shares of the given languages, and the log-likelihood at its end."""
    share = {k: 1 / len(probs) for k in probs}
    for _ in range(ROUNDS if len(probs) > 1 else 0):
        new = dict.fromkeys(probs, 0.0)
        for x in g:
            total = sum(share[k] * probs[k][x] for k in probs)
            for k in probs:
                new[k] += share[k] * probs[k][x] / total
        share = {k: v / len(g) for k, v in new.items()}
    return share, sum(math.log(sum(share[k] * probs[k][x] for k in probs)) for x in g)


def brute(rows):
    counts = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and text and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(fourgrams(text))
    totals = {k: c.total() + 0.5 * langid.N_BUCKETS for k, c in counts.items()}
    out = []
    for doc_id, text, _ in rows:
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        if not text or not any(map(str.isalpha, text)):
            out.append((doc_id, held, "und", 0.0, set()))
            continue
        g = fourgrams(text)
        probs = {k: {x: (counts[k][x] + 0.5) / totals[k] for x in set(g)} for k in counts}
        penalty = langid.GRAM * (2 + 0.5 * math.log(len(g) + 1))
        tried = []
        for n in range(1, len(probs) + 1):
            for names in combinations(sorted(probs), n):
                share, fit = likelihood(g, {k: probs[k] for k in names})
                tried.append((fit - penalty * n, names, share))
        _, names, share = max(tried, key=lambda x: x[0])
        best = min(names, key=lambda k: (-share[k], k))
        out.append((doc_id, held, best, share[best], set(names)))
    return out


def test_query_equals_plain_loops(spark, tmp_path):
    rnd = random.Random(21)
    vocabulary = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(60)]
                  for lang, letters in (("aa", "abcdefgé"), ("bb", "ghijklmß"), ("cc", "mnopqrst"))}
    say = lambda *langs: " ".join(rnd.choice(vocabulary[x]) for x in langs for _ in range(16))
    rows = [(i, say(lang), lang) for i, lang in enumerate(rnd.choices("abc", k=60)) for lang in [2 * lang]]
    rows += [(100 + i, say(*pair), None) for i, pair in enumerate([("aa", "bb"), ("bb", "cc"), ("cc", "aa"), ("aa", "bb", "cc")] * 2)]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 !? 3", "cc"), (None, say("bb"), "bb"), (3, rows[3][1], rows[3][2]), (203, say("aa").upper(), None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6), set(filter(None, r.langs.split(",")))) for r in QUERIES["op7_language"](spark, str(tmp_path)).collect()]
    want = [(i, h, x, round(s, 6), n) for i, h, x, s, n in brute(rows)]
    assert sorted(map(repr, ((*r[:4], sorted(r[4])) for r in got))) == sorted(map(repr, ((*r[:4], sorted(r[4])) for r in want)))
    assert max(len(r[4]) for r in want) == 3
