"""Licence scan by a positional index of rare words. DataFrame functions only.

Templates are short licence texts, each with a key phrase that must stand whole. Per template the words of highest
inverse document frequency (over the templates) are indexed with their positions. A document's words that are in the
index are looked up; each posting votes for the place where its template would begin. At such a place the shares of
all indexed words that stand at their relative positions are added up, and the key phrase is verified word by word. A
template is found if its key phrase stands and enough weight agrees. Phrases of the base rules are templates that are
all key phrase, so every place of them is found.

Input: doc_id, text (null: empty). Rows are independent and none is shuffled: nulls, repeated rows and clashing
columns change nothing; an empty or word-free text has no words and no finds. Output of scan: doc_id, n_words, finds
(label, base, start, score), one per template and place.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# Phrases and labels of the base rules
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Label, text and key phrase of the method's own templates: well-known opening or naming sentences of licences
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     "hereby granted free of charge"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", "redistribute it and or modify it under"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "distribute this software for any purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("reserved", "all rights reserved", "all rights reserved"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 8
MIN_SCORE = 0.5


class Index:
    """anchors: (template, position, word, weight); keys: (template, position, word); templates: (number, label,
    is base, key position, key length, weight in all)."""

    def __init__(self, base=tuple(BASE), templates=tuple(TEMPLATES), rare: int = RARE_WORDS):
        texts = [(label, p.split(), p.split(), True) for label, p in base]
        texts += [(label, t.split(), k.split(), False) for label, t, k in templates]
        df: dict[str, int] = {}
        for _, words, _, _ in texts:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        idf = {w: round(math.log(1 + len(texts) / n), 4) for w, n in df.items()}
        self.anchors, self.keys, self.templates = [], [], []
        for t, (label, words, key, is_base) in enumerate(texts):
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            # the rarest words; the rarest of the key phrase is always one, so no whole phrase is missed
            best = max(range(at, at + len(key)), key=lambda i: (idf[words[i]], -i))
            order = sorted(range(len(words)), key=lambda i: (i != best, -idf[words[i]], i))[:rare]
            self.anchors += [(t, i, words[i], idf[words[i]]) for i in sorted(order)]
            self.keys += [(t, at + i, w) for i, w in enumerate(key)]
            self.templates.append((t, label, is_base, at, len(key), round(sum(idf[words[i]] for i in order), 4)))


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, index: Index | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    x = index or Index()
    n = len(x.templates)
    by_word: dict[str, list] = {}
    for t, pos, w, _ in x.anchors:
        by_word.setdefault(w, []).append((t, pos))
    vocabulary = ", ".join(map(_text, by_word))
    posted = "map(" + ", ".join(
        f"{_text(w)}, array({', '.join(f'named_struct("t", {t}, "p", {p})' for t, p in ps)})" for w, ps in by_word.items()) + ")"
    known = "array(" + ", ".join(
        f"named_struct('label', {_text(label)}, 'base', {str(b).lower()}, 'at', {at}, 'total', {total}D, 'key', array("
        + ", ".join(_text(w) for tt, _, w in x.keys if tt == t) + "), 'anchors', array("
        + ", ".join(f"named_struct('p', {p}, 'w', {_text(w)}, 'v', {v}D)" for tt, p, w, v in x.anchors if tt == t) + "))"
        for t, label, b, at, _, total in x.templates) + ")"
    far = 1 << 20  # keeps places before the first word positive
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = id_and_text(docs).select("doc_id", F.regexp_extract_all(low, F.lit(WORD), 0).alias("words"))
    rows = rows.select("doc_id", "words", F.expr(
        f"array_compact(transform(words, (w, i) -> if(w in ({vocabulary}), i, null)))").alias("hits"))
    rows = rows.select("doc_id", "words", F.expr(
        f"array_distinct(flatten(transform(hits, i -> transform(element_at({posted}, words[i]), "
        f"x -> (i - x.p + {far}) * {n}L + x.t))))").alias("votes"))
    rows = rows.select("doc_id", "words", F.expr(
        f"transform(votes, v -> named_struct('t', get({known}, cast(v % {n} as int)), "
        f"'s', cast(v div {n} - {far} as int)))").alias("places"))
    score = "aggregate(x.t.anchors, 0D, (a, y) -> a + if(get(words, x.s + y.p) = y.w, y.v, 0D)) / x.t.total"
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(
        f"filter(transform(filter(places, x -> x.s + x.t.at >= 0 and slice(words, greatest(x.s + x.t.at, 0) + 1, "
        f"size(x.t.key)) = x.t.key), x -> named_struct('label', x.t.label, 'base', x.t.base, "
        f"'start', x.s + x.t.at, 'score', round({score}, 6))), y -> y.score >= {min_score}D)").alias("finds"))
    return rows


def summary(scanned: DataFrame) -> DataFrame:
    """One row per document: places of base phrases, labels and the best score."""
    starts = "transform(filter(finds, x -> x.base), x -> cast(x.start as long))"
    labels = "array_join(array_sort(array_distinct(transform({}, x -> x.label))), ',')"
    return scanned.select(
        "doc_id", "n_words", F.expr(f"cast(size({starts}) as long)").alias("n_base"),
        F.expr(f"array_min({starts})").alias("first_word"), F.expr(f"array_max({starts})").alias("last_word"),
        F.expr(labels.format("filter(finds, x -> x.base)")).alias("base_labels"),
        F.expr(labels.format("finds")).alias("labels"),
        F.expr("coalesce(array_max(transform(finds, x -> x.score)), 0D)").alias("score"),
        F.expr("cast(size(finds) as long)").alias("n_finds"))


def summary_sql(index: Index | None = None, min_score: float = MIN_SCORE) -> str:
    """The same by exploding all words and joining them with the templates."""
    x = index or Index()

    def values(rows):
        return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}',
    '{string.ascii_lowercase}'), '{WORD}') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
anchors(tid, tpos, word, idf) AS ({values(x.anchors)}),
keys(tid, kpos, word) AS ({values(x.keys)}),
templates(tid, label, base, key_at, klen, total) AS ({values(x.templates)}),
s AS (SELECT doc_id, tid, pos - tpos AS place, sum(idf::DOUBLE) AS score FROM t JOIN anchors USING (word) GROUP BY ALL),
k AS (SELECT doc_id, tid, pos - kpos AS place, count(*) AS n FROM t JOIN keys USING (word) GROUP BY ALL),
found AS (SELECT doc_id, label, base, place + key_at AS start, round(score / total::DOUBLE, 6) AS score
    FROM s JOIN k USING (doc_id, tid, place) JOIN templates USING (tid)
    WHERE n = klen AND round(score / total::DOUBLE, 6) >= {min_score}),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score, count(*) AS n_finds
    FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score, coalesce(n_finds, 0)::BIGINT AS n_finds
FROM w LEFT JOIN g USING (doc_id)"""
