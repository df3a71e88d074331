"""Texts in several languages pass the language stage."""

import random

import corpus_pipeline

from stackwarden.llm import langid


def test_texts_without_a_main_language_stay(spark, tmp_path):
    each = {"en": "the quick brown fox and the lazy dog ", "de": "der schnelle braune fuchs und ein fauler hund ",
            "fr": "le renard rapide saute par dessus un chien paresseux "}
    rows = [(4 * i + n * 1000, t * 20, k) for n, (k, t) in enumerate(each.items()) for i in range(12)]
    rows += [(9000, "".join(t * 15 for t in each.values()), None), (9001, "12 34 !?", None), (9002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, df, str(tmp_path)).collect()}
    assert got == {r[0] for r in rows} - {9001, 9002}


def test_texts_in_languages_that_nobody_labelled_go(spark, tmp_path):
    rnd = random.Random(4)
    words = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(300)]
             for k, letters in (("en", "abcdefgh"), ("de", "hijklmnö"), ("??", "opqrstuv"), ("ru", "абвгдежз"))}
    say = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    rows = [(i, say(k, 80), k) for i, k in enumerate(["en", "de"] * 60)]
    stay = [(1000, say("en", 60), None), (1001, say("en", 30) + " " + say("de", 30), None), (1002, say("de", 40) + " 5555 7556 9580 6262, x@y.org! " * 30, None),
            (1003, say("??", 2), None), (1004, say("en", 60) + " " + say("??", 15), None), (None, say("de", 9).upper(), None), (1005, say("de", 9000), "de")]
    go = [(2000, say("??", 60), None), (2001, say("ru", 60), None), (2002, say("??", 9000), None), (None, say("ru", 30), None)]
    df = spark.createDataFrame(rows + stay + go, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.known_language(spark, df, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows + stay))
    known = langid.identify(df).collect()  # op7 names a language for all of them, as its contract has it
    assert {r.lang_pred for r in known} == {"en", "de"}
