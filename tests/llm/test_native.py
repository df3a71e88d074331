"""Licence scan and quality rules against plain Python."""

import random
import re

from stackwarden.llm import licenses, quality

ODD = [None, "", " ", "\n\n", "one", "MIT License", "mit-license; MIT, LICENSE. mit licensed", "the GNU General Public License v3",
       "Licensed under CC BY-NC 4.0.", "apache license apache license", "İmit license K", "a b c a b c a b c",
       "x y z w\nx y z w\n\nx y z w", "# * $ % & | < >", "é\x0bé\x0cé é é é é", "general public license " * 400]


def docs(spark, texts):
    rows = [(i, t, 7, "w") for i, t in enumerate(texts)] + [(None, "mit license", 7, "w"), (0, texts[0], 7, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, hits string")


def test_every_place_of_a_base_phrase_is_found(spark):
    df = docs(spark, ODD)
    got = licenses.summary(licenses.scan(df)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "mit license" if r.doc_id is None else ODD[r.doc_id]
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = {label: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for label, p in licenses.BASE}
        every = sorted(i for v in places.values() for i in v)
        assert (r.n_words, r.n_base) == (len(words), len(every))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, v in places.items() if v))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_match_in_part_but_need_their_key_phrase(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = [mit, mit.replace("documentation", "document"), mit.replace("charge", "cost"), "x " + mit.split(" to any")[0]]
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(docs(spark, texts).filter("doc_id is not null"))).collect()}
    assert got[0].labels == "mit" and got[0].score == 1
    assert got[1].labels == "mit" and 0.5 <= got[1].score < 1
    assert got[2].labels == ""


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep))


def test_counts_equal_plain_python(spark):
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (3, 10, 100, 3000)]
    texts += ["\n".join(rnd.choice(["x y", "", " ", "q", "é漢🙂"]) for _ in range(40))]
    got = quality.judge(docs(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = plain_counts("mit license" if r.doc_id is None else texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_estimates_follow_agreeing_rules(spark):
    rules = [(n, f"{n} = 1", f"{n} = -1") for n in "abc"]
    rnd = random.Random(2)
    rows = []
    for _ in range(4000):
        good = rnd.random() < 0.7
        right = [rnd.random() < p for p in (0.95, 0.9, 0.6)]
        rows.append(tuple((1 if good == r else -1) if rnd.random() < 0.9 else 0 for r in right))
    df = spark.createDataFrame(rows, "a int, b int, c int").select(*quality.votes(rules))
    p = quality.estimate(quality.count_votes(df, rules), rules, rounds=40, good_from=0.0, bad_from=0.0)
    assert abs(p["prior"] - 0.7) < 0.08 and p["good_a"] > p["good_c"] and p["bad_a"] > p["bad_c"]


def test_kept_rows_are_unchanged_and_empty_tables_pass(spark):
    good = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(1, good, "x", 2.0), (2, "bad bad", "x", 2.0), (None, None, None, None)],
                               "doc_id long, text string, w string, quality double")
    assert [tuple(r) for r in quality.keep_good(df).collect()] == [(1, good, "x", 2.0)]
    assert quality.keep_good(df.limit(0)).columns == df.columns and quality.judge(df.limit(0)).count() == 0
    assert licenses.scan(df.limit(0)).count() == 0
