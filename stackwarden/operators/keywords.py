"""Keywords of texts and tags of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import keyword_tokens
from .exemplars import folder_scores
from .ranking import top_per_group


def _most_frequent(words: Column, top_n: int) -> Column:
    """The top_n of an array of words as structs (less = -count, first_pos, word), best first. One pass
    over the words in sorted order, holding the current word's count and the best so far."""
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    best = "array<struct<less:int,first_pos:int,word:string>>"
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("first_pos"),
                     F.array().cast(best).alias("best"))

    def closed(acc: Column) -> Column:
        done = F.struct((-acc["n"]).alias("less"), acc["first_pos"].alias("first_pos"), acc["word"].alias("word"))
        # most words are rare and do not get into a full list: no sorting for them
        fits = F.when(F.size(acc["best"]) < top_n, acc["n"] > 0).otherwise(done < F.element_at(acc["best"], -1))
        return F.when(fits, F.slice(F.sort_array(F.concat(acc["best"], F.array(done))), 1, top_n)).otherwise(acc["best"])

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["word"] == x["word"], F.lit(False))
        return F.struct(x["word"].alias("word"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"),
                        F.when(same, acc["first_pos"]).otherwise(x["pos"]).alias("first_pos"),
                        F.when(same, acc["best"]).otherwise(closed(acc)).alias("best"))

    return F.aggregate(ordered, start, step, closed)


def frequent_words(docs: DataFrame, top_n: int = 6) -> DataFrame:
    """(asset_id, rank, word, n): most frequent words, the one seen first of equals. A document is one row,
    so its words are counted in place and nothing is shuffled."""
    top = docs.select("asset_id", F.posexplode(_most_frequent(keyword_tokens("text"), top_n)).alias("pos", "w"))
    return top.select("asset_id", (F.col("pos") + 1).alias("rank"), F.col("w.word").alias("word"),
                      (-F.col("w.less")).cast("long").alias("n"))


def tag_scores(images: DataFrame, tags: DataFrame, top_n: int | None = None) -> DataFrame:
    """(asset_id, tag, tag_ord, score): cosine of every image vector with every tag vector, or the best n."""
    store = tags.select(F.concat(F.lpad(F.col("tag_ord").cast("string"), 10, "0"), F.lit("|"), "tag").alias("folder"), F.lit("image").alias("modality"),
                        F.col("tag_ord").cast("long").alias("seq"), "vec")
    q = images.select("asset_id", F.lit("image").alias("modality"), "vec")
    # one unit vector per tag: best example and centroid are the same
    s = folder_scores(q, store, top_n)
    return s.select("asset_id", F.expr("substring(folder, 12)").alias("tag"),
                    F.substring("folder", 1, 10).cast("int").alias("tag_ord"), "score")


def image_tags(images: DataFrame, tags: DataFrame, top_n: int = 6, min_score: float = K.TAG_MIN_SCORE) -> DataFrame:
    """(asset_id, rank, tag, score): the best n tags first, then only those that score enough."""
    best = top_per_group(tag_scores(images, tags, top_n), ["asset_id"],
                         [F.col("score").desc(), F.col("tag_ord").asc()], top_n)
    return best.filter(F.col("score") >= min_score).select("asset_id", "rank", "tag", "score")
