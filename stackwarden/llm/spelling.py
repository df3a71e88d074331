"""Spelling variants: words one edit apart, found through pivotal grams.

Words are counted over all texts. A word's bigrams are ranked, rarest in the vocabulary first; its prefix is the
2 * EDITS + 1 rarest. Dynamic programming picks EDITS + 1 of these that do not overlap and are rarest together: the
pivots. An edit spoils one of two disjoint bigrams at most, so of two words one edit apart, the word whose prefix ends
earlier has a pivot that the other holds too, and holds within its prefix. A bigram may stand in a word more than once:
a prefix also takes what equals its last bigram, up to 2 * EDITS more, as an edit puts no more than that before a
bigram both words share. Hence pivots are joined with prefixes. Position limits make the join narrow: the edit lies before or after the bigram that
both share, which fixes where the bigram stands in a word of given length, and leaves the other side of the word as it
is; bigram, place, length and that side (with half of the other, where it is short) are one key. Found pairs are verified by edit distance.

A word's form is the near word that occurs most (ties: smallest in code-point order), if it occurs `ratio` times as
often at least; the root is where following forms ends. Forms occur more often each time, so chains are short.

Input: doc_id, text (null: no words). A null doc_id counts as an empty string where misspellings are planted. Repeated
rows count again. Other columns are not looked at. An empty table, or one without words, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import hold, id_and_text, over_batches

GRAM = 2
EDITS = 1
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
# Letters beside a gram that tell words apart well enough
SIDE = 3
# Words up to this length are compared in the JVM, whose edit distance takes quadratic time
SHORT = 64
# Counted words a task holds before it sends them on
HELD_WORDS = 200_000
# Letters of index rows in one batch
HELD_CHARS = 8_000_000

# A letter of the fixed word pattern; with A-Z in lower case there are 90, so 8100 bigrams at most
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(LOWER)


def planted(doc_id: int | None, run: str) -> str:
    """The run, without one of its code points if 31 divides the hash of id and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None, min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """word, n. `change` may replace each run of a document, as long as it takes no more than it needs: a function of
    doc_id and run. Tasks count before they send."""
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("spelling")
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for w, n in Counter(runs.findall(text or "")).items():
                    own[lowered(w)] += n
                for w, n in own.items():
                    w = w if change is None else change(doc_id, w)
                    if len(w) >= min_chars:
                        held[w] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = id_and_text(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def grams_of(word: str) -> list[str]:
    return [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams, rarest first. The alphabet bounds them: 90 letters make 8100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                n.update(grams_of(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["gram", "n"])

    counted = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {g: i for i, (_, g) in enumerate(sorted((r.n, r.gram) for r in counted.collect()))}


def prefix_of(ranks: list[int]) -> tuple[list[int], int, int]:
    """Places of the prefix's grams by rank and place, how many of them pivots are picked from, and the last rank."""
    order = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))[:2 * GRAM * EDITS + 1]
    own = min(GRAM * EDITS + 1, len(order))
    last = ranks[order[own - 1]]
    return [i for i in order if ranks[i] <= last], own, last


def pivots_of(places: list[int], ranks: list[int]) -> list[int]:
    """EDITS + 1 of the places (ascending) that do not overlap, with the smallest sum of ranks: best[i][k] is the best
    choice of k among the first i places."""
    best: list[dict[int, tuple[int, list[int]]]] = [{0: (0, [])}]
    for at, p in enumerate(places):
        now = dict(best[at])
        before = best[sum(q + GRAM <= p for q in places[:at])]
        for k, (cost, chosen) in before.items():
            if k <= EDITS and (k + 1 not in now or cost + ranks[p] < now[k + 1][0]):
                now[k + 1] = (cost + ranks[p], [*chosen, p])
        best.append(now)
    return best[-1][EDITS + 1][1]


def _keys(rank: int, place: int, size: int, after: bool, word: str, at: int) -> list[int]:
    """Where word looks, or is found, by its gram at `at`, in words of `size` letters that hold it at `place` and differ
    after (or before) it. All on the other side is alike. Where that is short, one of two parts of the differing side is
    alike as well: the one next to the gram or the one at the word's end; both are a letter shorter than that side, so
    they fit a word that is a letter shorter."""
    same, rest = (word[:at], word[at + GRAM:]) if after else (word[at + GRAM:], word[:at])
    want = size - place - GRAM if after else place
    if want < 0 or place < 0:
        return []
    head = b"%d,%d,%d,%d," % (rank, place, size, after) + same.encode()
    if len(same) >= SIDE:
        return [xxhash.xxh3_64_intdigest(head) - (1 << 63)]
    near = max(want - 1, 0) // 2
    far = max(want - 1 - near, 0)
    parts = (rest[:near], rest[len(rest) - far:]) if after else (rest[len(rest) - near:], rest[:far])
    return [xxhash.xxh3_64_intdigest(head + b",%d," % i + part.encode()) - (1 << 63) for i, part in enumerate(parts)]


def index(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """k, pivot, last, word, n: each word under its pivots (where it looks) and its prefix (where it is found)."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("spelling")
        rank_of, names = shared.value, ["k", "pivot", "last", "word", "n"]
        for b in batches:
            rows: list[tuple[int, bool, int, str, int]] = []
            held = 0
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ranks, size = [rank_of[g] for g in grams_of(w)], len(w)
                places, own, last = prefix_of(ranks)
                keys = []
                for p in places:
                    keys += [(k, False) for after in (True, False) for k in _keys(ranks[p], p, size, after, w, p)]
                for p in pivots_of(sorted(places[:own]), ranks):
                    for more in range(-EDITS, EDITS + 1):
                        keys += [(k, True) for k in _keys(ranks[p], p, size + more, True, w, p)]
                        keys += [(k, True) for k in _keys(ranks[p], p + more, size + more, False, w, p)]
                rows += [(k, pivot, last, w, n) for k, pivot in keys]
                held += len(keys) * len(w)
                if held > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names)

    return words.select("word", "n").mapInArrow(run, "k long, pivot boolean, last long, word string, n long")


def one_apart(a: str, b: str) -> bool:
    """Whether one code point put in, taken out or replaced makes a into b. One pass, however long the words are."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)):] == b[same + (len(b) >= len(a)):]


def _verified(pairs: DataFrame) -> DataFrame:
    def make():
        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(map(one_apart, b.column(0).to_pylist(), b.column(2).to_pylist()), pa.bool_()))

        return apply

    return over_batches(pairs, make, "a string, na long, b string, nb long")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each ordered pair of words one edit apart once. words: word, n, all different."""
    rows = cut_lineage(index(words, gram_ranks(words)))
    ask, held = rows.filter("pivot"), rows.filter("NOT pivot")
    ask = ask.select("k", F.col("last").alias("upto"), F.col("word").alias("a"), F.col("n").alias("na"))
    held = held.select("k", "last", F.col("word").alias("b"), F.col("n").alias("nb"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "k").filter((F.col("last") >= F.col("upto")) & (F.col("a") != F.col("b"))).select("a", "na", "b", "nb")

    long = F.char_length("a") > SHORT
    near = met(ask.filter(~long), held).filter(F.levenshtein("a", "b", EDITS) == EDITS)
    near = near.union(_verified(met(ask.filter(long), held.filter(F.char_length("b") >= SHORT))))
    low = F.col("a") < F.col("b")
    pairs = near.select(F.least("a", "b").alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"),
                       F.greatest("a", "b").alias("b"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n"))
                                          )).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word, root: where following forms ends. Each round doubles the steps taken."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("at"), F.col("root").alias("on"))
        moved = now.join(step, F.col("root") == F.col("at"), "left")
        if moved.filter("on IS NOT NULL").isEmpty():
            return now
        now = cut_lineage(moved.select("word", F.coalesce("on", "root").alias("root")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. words: word, n, all different."""
    words = cut_lineage(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    best = best.select(F.col("word").alias("of"), "n_near", "b.form", (-F.col("b.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    found = cut_lineage(words.join(best, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    ends = roots(found.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "of")
    return found.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(crc32_sql: Callable[[str], str]) -> str:
    """The default parameters over documents, with planted misspellings. Words one edit apart share what is left when
    one code point is taken out of the longer of them, or of both at the same place."""
    return f"""
WITH w AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{MIN_CHARS},}}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM w GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM o),
p AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM p WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
e AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
t AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM e GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form,
    CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n FROM v LEFT JOIN t ON v.word = t.word),
r AS (WITH RECURSIVE c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
    SELECT c.word, c.at FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(r.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN r ON f.word = r.word"""
