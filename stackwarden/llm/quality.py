"""Quality rules by weak supervision. DataFrame functions only.

Rules look at a text's counts and vote to keep it (1), to reject it (-1) or abstain (0). Texts are counted by their
votes, so there are at most 3^rules distinct rows, whatever the corpus; expectation-maximisation over those rows
estimates the share of good texts and, for good and bad texts apart, how often each rule that votes is right. A text is
kept if its posterior probability of being good reaches a threshold and no hard limit of the base rules is broken.

Input: doc_id, text (null: no words). Rows are independent but for the estimates, which count every row; an empty
table gives no rows. Repeated windows are found by sorting hashes with their positions and comparing the words
themselves; where different windows share a hash, the windows are sorted instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path
from .common import id_and_text, whole_rows

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 15
START_PRIOR = 0.8
START_ACCURACY = 0.8
START_BAD = 0.5
SMOOTH = 1.0
KEEP_FROM = 0.5
# What each rule at least gets right among good and among bad texts
GOOD_FROM = 0.99
BAD_FROM = 0.1
MOST_ROUNDS = 1000

# Rule: when it votes to keep, when to reject (SQL over the counts)
RULES = [
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    ("lines", "n_dup_lines = 0", "3 * n_dup_lines > n_lines"),
    ("repeats", "4 * n_repeat_words <= n_words", "2 * n_repeat_words > n_words"),
]
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_counts(df: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and the counts of df.text."""
    c = list(carried)
    t = F.coalesce("text", F.lit(""))
    df = df.select(*c, F.regexp_extract_all(t, F.lit(WORD), 0).alias("w"),
                   F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                   F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                   F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    c += ["word_chars", "n_symbols"]
    df = df.select(*c, "w", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.expr("length(bin(size(w)))").alias("b"))
    c += ["n_words", "n_lines", "n_dup_lines"]
    # hash of each window above its position; equal windows become neighbours
    df = df.select(*c, "w", "b", F.expr("if(n_words < 3, array(), sort_array(transform(sequence(0, size(h) - 3), "
                                        "i -> shiftleft(xxhash64(h[i], h[i + 1], h[i + 2]), b) | i)))").alias("s"))
    df = df.select(*c, "w", "b", "s", F.expr(
        "if(size(s) < 2, array(), filter(sequence(1, size(s) - 1), j -> "
        "shiftright(s[j], b) = shiftright(s[j - 1], b)))").alias("j"))
    df = df.select(*c, "w", F.expr("transform(j, x -> cast(s[x] & (shiftleft(1L, b) - 1) as int))").alias("p"),
                   F.expr("transform(j, x -> cast(s[x - 1] & (shiftleft(1L, b) - 1) as int))").alias("q"))
    clean = ("forall(arrays_zip(p, q), x -> w[x.p] = w[x.q] and w[x.p + 1] = w[x.q + 1] and w[x.p + 2] = w[x.q + 2])")
    sort = ("array_sort(transform(sequence(0, size(w) - 3), i -> named_struct('t', concat_ws(' ', w[i], w[i + 1], "
            "w[i + 2]), 'i', i)))")
    by_text = (f"transform(array({sort}), s -> flatten(transform(filter(sequence(1, size(s) - 1), "
               "j -> s[j].t = s[j - 1].t), j -> array(s[j].i, s[j - 1].i))))[0]")
    df = df.select(*c, F.expr(f"array_distinct(if({clean}, concat(p, q), {by_text}))").alias("p"))
    return df.select(*c, F.expr("cast(size(array_distinct(concat(p, transform(p, x -> x + 1), "
                                "transform(p, x -> x + 2)))) as long)").alias("n_repeat_words"))


def votes(rules=tuple(RULES)) -> list[Column]:
    return [F.expr(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END").alias(f"v_{name}") for name, yes, no in rules]


def _terms(rules, p: dict[str, float]) -> tuple[str, str]:
    """Likelihood of the votes for good and for bad texts, as SQL. A vote picks its factor out of an array, which
    generated code holds as data: so the rounds of the estimation share their compiled code."""
    terms = []
    for side, prior in (("good", p["prior"]), ("bad", 1 - p["prior"])):
        each = []
        for j, (name, *_) in enumerate(rules):
            right = p[f"{side}_{name}"]
            factors = [1 - right, 1.0, right] if side == "good" else [right, 1.0, 1 - right]
            factors = [prior * x for x in factors] if j == 0 else factors
            each.append(f"array({', '.join(repr(x) + 'D' for x in factors)})[v_{name} + 1]")
        terms.append(" * ".join(each))
    return terms[0], terms[1]


def posterior(p: dict[str, float], rules=tuple(RULES)) -> Column:
    """Probability that a text is good, given its votes."""
    good, bad = _terms(rules, p)
    return F.expr(f"({good}) / (({good}) + ({bad}))")


def estimate(counted: DataFrame, rules=tuple(RULES), rounds: int | None = None, good_from: float = GOOD_FROM,
             bad_from: float = BAD_FROM) -> dict[str, float]:
    """counted: distinct votes with their number n, at most 3^rules rows, which are summed here. Goes on until nothing
    changes, or for so many rounds. No rule may turn round: left free (bounds of zero), the estimate explains the
    rejections of a rule that few others back as noise and ends with rules that vouch for what they reject. A rule's
    thresholds are set so that it rejects next to no good text (good_from) and some of the bad (bad_from): so a vote to
    reject always counts against a text, by bad_from / (1 - good_from) at least."""
    rows = counted.collect()
    good0, bad0 = max(START_ACCURACY, good_from), max(START_BAD, bad_from)
    if not rows:
        return {"prior": START_PRIOR} | {f"{k}_{name}": x for name, *_ in rules for k, x in (("good", good0), ("bad", bad0))}
    v = np.array([[r[f"v_{name}"] for name, *_ in rules] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    prior, good, bad = START_PRIOR, np.full(len(rules), good0), np.full(len(rules), bad0)
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        g = prior * np.where(v == 1, good, np.where(v == -1, 1 - good, 1)).prod(axis=1)
        b = (1 - prior) * np.where(v == -1, bad, np.where(v == 1, 1 - bad, 1)).prod(axis=1)
        g, b = n * g / (g + b), n * b / (g + b)

        def right(weight, vote):
            return ((v == vote) * weight[:, None]).sum(axis=0) + SMOOTH, ((v != 0) * weight[:, None]).sum(axis=0) + 2 * SMOOTH

        (gy, gn), (by, bn) = right(g, 1), right(b, -1)
        last, now = (prior, good, bad), ((g.sum() + SMOOTH) / (n.sum() + 2 * SMOOTH), np.maximum(gy / gn, good_from), np.maximum(by / bn, bad_from))
        prior, good, bad = now
        if rounds is None and max(np.abs(x - y).max() for x, y in zip(last, now)) < 1e-9:
            break
    return {"prior": float(prior)} | {f"{k}_{name}": float(x) for k, side in (("good", good), ("bad", bad)) for (name, *_), x in zip(rules, side)}


def count_votes(with_votes: DataFrame, rules=tuple(RULES)) -> DataFrame:
    return cut_lineage(with_votes.groupBy(*[f"v_{name}" for name, *_ in rules]).agg(F.count("*").alias("n")).coalesce(1))


def judge(docs: DataFrame, rules=tuple(RULES), keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, counts, votes, base_failed, quality (the posterior) and kept for every row, after ROUNDS rounds."""
    rows = cut_lineage(with_counts(id_and_text(docs), "doc_id").select("*", *votes(rules)))
    p = estimate(count_votes(rows, rules), rules, ROUNDS)
    rows = rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", posterior(p, rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def keep_good(docs: DataFrame, rules=tuple(RULES), keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that are good, unchanged, by an estimate that goes on until nothing changes. Rows are written once
    with their counts and votes, so nothing is counted twice and nothing is joined back."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "quality")
    made = with_counts(whole_rows(docs), "row").select("*", *votes(rules))
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    p = estimate(count_votes(rows, rules), rules)
    return rows.filter(~F.expr(BASE_FAILED) & (posterior(p, rules) >= keep_from)).select("row.*")


def judge_sql(rules=tuple(RULES), rounds: int = ROUNDS, keep_from: float = KEEP_FROM) -> str:
    """The same in DuckDB, with windows grouped as texts and one common table per round."""
    cases = ", ".join(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END AS v_{name}" for name, yes, no in rules)
    good = " * ".join(["prior"] + [f"CASE v_{n} WHEN 1 THEN good_{n} WHEN -1 THEN 1 - good_{n} ELSE 1 END" for n, *_ in rules])
    bad = " * ".join(["(1 - prior)"] + [f"CASE v_{n} WHEN -1 THEN bad_{n} WHEN 1 THEN 1 - bad_{n} ELSE 1 END" for n, *_ in rules])
    steps = ["p0 AS (SELECT " + ", ".join([f"{START_PRIOR}::DOUBLE AS prior"] + [
        f"{x}::DOUBLE AS {k}_{n}" for n, *_ in rules for k, x in (("good", max(START_ACCURACY, GOOD_FROM)), ("bad", max(START_BAD, BAD_FROM)))]) + ")"]
    for i in range(rounds):
        outs = [f"(sum(n * g) + {SMOOTH}) / (sum(n) + {2 * SMOOTH}) AS prior"]
        for n, *_ in rules:
            outs.append(f"greatest({GOOD_FROM}, (sum(CASE WHEN v_{n} = 1 THEN n * g ELSE 0 END) + {SMOOTH}) / (sum(CASE WHEN v_{n} <> 0 THEN n * g ELSE 0 END) + {2 * SMOOTH})) AS good_{n}")
            outs.append(f"greatest({BAD_FROM}, (sum(CASE WHEN v_{n} = -1 THEN n * (1 - g) ELSE 0 END) + {SMOOTH}) / (sum(CASE WHEN v_{n} <> 0 THEN n * (1 - g) ELSE 0 END) + {2 * SMOOTH})) AS bad_{n}")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT {', '.join(outs)} FROM (SELECT votes.*, ({good}) / (({good}) + ({bad})) AS g FROM votes, p{i}))")
    word = WORD.replace("\\x20", " ")
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
    WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
tri AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(3) r(k) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
v AS MATERIALIZED (SELECT *, {cases} FROM c),
votes AS MATERIALIZED (SELECT {', '.join(f'v_{n}' for n, *_ in rules)}, count(*) AS n FROM v GROUP BY ALL),
{', '.join(steps)},
q AS (SELECT v.*, {BASE_FAILED} AS base_failed, ({good}) / (({good}) + ({bad})) AS quality FROM v, p{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND quality >= {keep_from} AS kept, round(quality, 4) AS quality FROM q"""
