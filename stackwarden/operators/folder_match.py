"""Matching known folder names against an asset's text and file name.

Level 1: a folder segment occurs in the text or name once spaces and punctuation are gone. The first such
segment, in folder order, wins outright: all segments are searched for at once, by an automaton that reads
each text once. Else the best folder whose words are found, spelling mistakes allowed. That search is an equi
join on pieces of words (if two words are k edits apart, one of k + 1 pieces of the first is in the second,
moved by at most k places), so it does not compare everything with everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.paths import unify_separators
from ..functions.text import bigrams, compact, tokens
from ..session import cut_lineage, is_small

MIN_SEGMENT = 4
OFTEN_USED = 3
# So few segments or words go into the plan as a literal; more of them are joined.
FEW = 256
# Letters of all segments and folder names up to which an automaton of them is sent to every task.
AUTOMATON_LETTERS = 16 << 20


def segments(folders: DataFrame) -> DataFrame:
    """Segments of known folders (folder, used_count, first_seen), with their place in folder order."""
    s = folders.select("folder", "used_count", "first_seen",
                       F.posexplode(F.split(unify_separators("folder"), "/")).alias("seg_idx", "segment"))
    s = s.withColumn("compact", compact("segment")).filter(F.length("compact") >= MIN_SEGMENT)
    toks = tokens("segment", MIN_SEGMENT)
    place = F.struct((-F.col("used_count")).alias("u"), F.col("first_seen"), F.col("folder"), F.col("seg_idx"))
    return s.select("folder", "used_count", place.alias("place"), "compact",
                    F.when(F.size(toks) > 0, toks).otherwise(F.array("compact")).alias("needles"))


def _bonus() -> Column:
    return F.when(F.col("used_count") >= OFTEN_USED, 0.05).otherwise(0.0)


def _literal(rows: list[dict], schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def whole_name_matches(assets: DataFrame, segs: DataFrame, few: int = FEW, automaton_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """Level 1: the first segment that occurs in the compact text or file name of (asset_id, text, filename)."""
    if is_small(segs, few):
        rows = [{"folder": r.folder, "used_count": r.used_count, "c": r.compact}
                for r in segs.orderBy("place").collect()]  # at most `few`
        known = _literal(rows, "folder string, used_count bigint, c string")

        def hit(a: Column) -> Column:
            return F.slice(F.transform(
                F.filter(known, lambda s: a["t"].contains(s["c"]) | a["n"].contains(s["c"])),
                lambda s: F.struct(s["folder"], s["used_count"], a["t"].contains(s["c"]).alias("in_text"),
                                   a["n"].contains(s["c"]).alias("in_name"))), 1, 1)

        # the one-element array holds the compact strings, so that they are worked out once per asset
        both = F.array(F.struct(compact("text").alias("t"), compact("filename").alias("n")))
        first = assets.select("asset_id", F.explode(F.flatten(F.transform(both, hit))).alias("s"))
        return _whole_confidence(first.select("asset_id", "s.*"))
    letters = segs.agg(F.sum(F.length("compact") + F.length("folder"))).first()[0] or 0
    if letters <= automaton_letters:
        return _whole_confidence(_by_automaton(assets, segs))
    return _whole_confidence(_by_anchors(assets, segs))


def _by_automaton(assets: DataFrame, segs: DataFrame) -> DataFrame:
    """One pass over each text with all segments at once. The automaton is built by each task from the broadcast list,
    whose size the caller has counted. Of equal segments the first in folder order stands for all."""
    known: dict[str, tuple[int, str, int]] = {}
    for i, r in enumerate(segs.select("place", "folder", "used_count", "compact").orderBy("place").toLocalIterator()):
        known.setdefault(r.compact, (i, r.folder, r.used_count))
    shared = assets.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for word, found in shared.value.items():
            machine.add_word(word, found)
        machine.make_automaton()
        none = (float("inf"), None, None)

        def first(text: str | None) -> tuple:
            return min((found for _, found in machine.iter(text)), default=none) if text else none

        for b in batches:
            rows = []
            for asset_id, text, name in zip(*(c.to_pylist() for c in b.columns)):
                t, n = first(text), first(name)
                best = min(t, n, key=lambda found: found[0])
                if best is not none:
                    rows.append((asset_id, best[1], best[2], t is best, n is best))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["asset_id", "folder", "used_count", "in_text", "in_name"])

    flat = assets.select(F.col("asset_id").cast("long").alias("asset_id"), compact("text").alias("t"), compact("filename").alias("n"))
    return flat.mapInArrow(run, "asset_id long, folder string, used_count long, in_text boolean, in_name boolean") if known else flat.select(
        "asset_id", F.lit("").alias("folder"), F.lit(0).alias("used_count"), F.lit(False).alias("in_text"), F.lit(False).alias("in_name")).limit(0)


def _by_anchors(assets: DataFrame, segs: DataFrame) -> DataFrame:
    """For lists of segments too large to be sent to every task: runs of letters meet segments on their first letters."""
    longest = segs.agg(F.max(F.length("compact"))).first()[0]

    def windows(col: str, where: str) -> DataFrame:
        # every run of up to `longest` letters, one per position; the text itself is not copied along
        runs = F.regexp_extract_all(compact(col), F.lit(f"(?=(.{{{MIN_SEGMENT},{longest}}}))"), 1)
        return assets.select("asset_id", F.explode(F.array_distinct(runs)).alias("run"), F.lit(where).alias("place_of"))

    w = windows("text", "text").unionByName(windows("filename", "name"))
    hits = w.withColumn("anchor", F.substring("run", 1, MIN_SEGMENT)).join(
        segs.select("place", "folder", "used_count", "compact", F.substring("compact", 1, MIN_SEGMENT).alias("anchor")),
        "anchor",
    ).filter(F.col("run").startswith(F.col("compact")))
    per_segment = hits.groupBy("asset_id", "place", "folder", "used_count").agg(
        F.max(F.col("place_of") == "text").alias("in_text"), F.max(F.col("place_of") == "name").alias("in_name"))
    first = per_segment.groupBy("asset_id").agg(
        F.min(F.struct("place", "folder", "used_count", "in_text", "in_name")).alias("b"))
    return first.select("asset_id", "b.*")


def _whole_confidence(first: DataFrame) -> DataFrame:
    both = F.when(F.col("in_text") & F.col("in_name"), 0.10).otherwise(0.0)
    return first.select("asset_id", "folder", F.least(F.lit(0.80) + _bonus() + both, F.lit(0.95)).alias("confidence"))


def asset_words(assets: DataFrame) -> DataFrame:
    """Distinct (asset_id, word): words of text and file name, and neighbouring words written together."""
    t = assets.select("asset_id", tokens("text").alias("a"), tokens("filename").alias("b"))
    words = F.concat("a", "b", bigrams("a"), bigrams("b"))
    return t.select("asset_id", F.explode(F.array_distinct(words)).alias("word"))


def _pieces(length: Column, k: Column) -> Column:
    """Start (1-based) and length of the k + 1 pieces a word of the given length is cut into."""
    base = F.floor(length / (k + 1)).cast("int")
    extra = length % (k + 1)
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(
        i.alias("no"),
        (i * base + F.least(i, extra) + 1).alias("at"),
        (base + F.when(i < extra, 1).otherwise(0)).alias("n")))


def _near_listed(words: DataFrame, needles: DataFrame) -> DataFrame:
    """Every word with each needle it is close to, the needles (at most FEW) being a literal list."""
    listed = sorted(r.needle for r in needles.collect())
    sizes = [len(n) for n in listed] or [0]
    gap = fuzzy.MAX_LENGTH_GAP
    limit = fuzzy.most_edits(max(sizes))
    close = F.filter(F.split(F.lit(" ".join(listed)), " "), lambda n: fuzzy.may_match(n, F.col("word"), limit))
    fits = F.length("word").between(min(sizes) - gap, max(sizes) + gap)
    return words.filter(fits).select("*", F.explode(close).alias("needle"))


def _alike(close: DataFrame) -> DataFrame:
    return close.withColumn("ratio", fuzzy.fuzzy_ratio("needle", "word")).filter(
        F.col("ratio") >= fuzzy.MIN_RATIO).select("needle", "word")


def fuzzy_words(needles: DataFrame, words: DataFrame, few: int = FEW) -> DataFrame:
    """Distinct (needle, word) that are equal or alike by Ratcliff-Obershelp at 0.85."""
    needles = needles.select("needle").distinct()
    if is_small(needles, few):
        return _alike(_near_listed(words.select("word").distinct(), needles).select("needle", "word"))
    return _alike(_close_by_pieces(needles, words))


def _close_by_pieces(needles: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (needle, word) within the edit bound, joined on a piece they share."""
    gap = fuzzy.MAX_LENGTH_GAP
    n = needles.select("needle").distinct().withColumn("nl", F.length("needle"))
    n = n.withColumn("wl", F.explode(F.sequence(F.col("nl") - gap, F.col("nl") + gap)))
    k = F.floor((F.col("nl") + F.col("wl")) * (1.0 - fuzzy.MIN_RATIO) + 1e-9).cast("int")
    n = n.withColumn("k", k).withColumn("p", F.explode(_pieces(F.col("nl"), F.col("k"))))
    n = n.select("needle", "nl", "wl", F.col("p.no").alias("no"),
                 F.expr("substring(needle, p.at, p.n)").alias("piece"))

    lengths = needles.select(F.length("needle").alias("nl")).distinct()
    w = words.select("word").distinct().withColumn("wl", F.length("word"))
    w = w.withColumn("nl", F.explode(F.sequence(F.greatest(F.col("wl") - gap, F.lit(fuzzy.MIN_NEEDLE)),
                                                F.greatest(F.col("wl") + gap, F.lit(fuzzy.MIN_NEEDLE)))))
    w = w.join(lengths, "nl", "left_semi")
    w = w.withColumn("k", k).withColumn("p", F.explode(_pieces(F.col("nl"), F.col("k"))))
    first = F.greatest(F.lit(1), F.col("p.at") - F.col("k"))
    last = F.least(F.col("wl") - F.col("p.n") + 1, F.col("p.at") + F.col("k"))
    w = w.filter(last >= first).withColumn("at", F.explode(F.sequence(first, last)))
    w = w.select("word", "nl", "wl", F.col("p.no").alias("no"), F.expr("substring(word, at, p.n)").alias("piece")).distinct()

    met = w.join(n, ["nl", "wl", "no", "piece"]).filter(fuzzy.may_match("needle", "word"))
    return met.select("needle", "word").distinct()


def word_matches(assets: DataFrame, segs: DataFrame, settled: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Levels 2 and 3: the folder segment most of whose words are found, for assets not settled before.

    Settled assets are taken out once only ids and words are left: a join before would shuffle the texts.
    """
    seg_needles = segs.select("place", "folder", "used_count", F.size("needles").alias("n_needles"),
                              F.explode("needles").alias("needle"))
    seg_needles = seg_needles.groupBy("place", "folder", "used_count", "n_needles", "needle").agg(
        F.count(F.lit(1)).alias("times"))
    words = asset_words(assets)
    needles = seg_needles.select("needle").distinct()
    if is_small(needles, few):
        # the texts are read once; what is close to a needle is little and is written out
        close = _near_listed(words, needles)
        close = cut_lineage(close if settled is None else close.join(settled.select("asset_id"), "asset_id", "left_anti"))
        alike = _alike(close.select("needle", "word").distinct())
        found = close.join(alike, ["needle", "word"]).select("asset_id", "needle").distinct()
    else:
        alike = _alike(_close_by_pieces(needles, words))
        found = words.join(alike, "word").select("asset_id", "needle").distinct()
        if settled is not None:
            found = found.join(settled.select("asset_id"), "asset_id", "left_anti")
    scored = found.join(seg_needles, "needle").groupBy("asset_id", "place", "folder", "used_count", "n_needles").agg(
        F.sum("times").alias("n_found"))
    ratio = F.col("n_found") / F.col("n_needles")
    conf = F.when(ratio >= 1.0, F.lit(0.75) + _bonus()).when(
        (ratio >= 0.6) & (F.col("n_needles") >= 2), 0.55 + 0.1 * ratio)
    best = scored.withColumn("confidence", conf).filter("confidence IS NOT NULL").groupBy("asset_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "place", "folder")).alias("b"))
    return best.select("asset_id", F.col("b.folder").alias("folder"), (-F.col("b.c")).alias("confidence"))


def match_known_folders(assets: DataFrame, folders: DataFrame, few: int = FEW) -> DataFrame:
    """(asset_id, folder, confidence) for the assets that name a known folder."""
    segs = cut_lineage(segments(folders))
    whole = cut_lineage(whole_name_matches(assets, segs, few))
    return whole.unionByName(word_matches(assets, segs, whole, few))


def folders_containing(folders: DataFrame, typed: str) -> DataFrame:
    """Folders whose name contains what was typed, without regard to case."""
    return folders.filter(F.lower("folder").contains(typed.lower()))
