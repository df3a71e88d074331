"""Suggest a folder for every asset, learn from placed ones, and plan the moves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.hashing import cache_fingerprint
from ..functions.paths import file_name, is_document, join_folder
from ..functions.text import has_text, passage_input, tag_input
from ..operators import exemplars as X
from ..operators.duplicates import all_but_largest
from ..operators.filing import cascade, known_signatures, picture_hint, with_keyword_category, with_learned
from ..operators.folder_match import match_known_folders
from ..operators.keywords import frequent_words, image_tags
from ..operators.moves import free_names
from ..operators.ranking import top_per_group

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def suggest_folders(
    assets: DataFrame,
    folders: DataFrame,
    rules: DataFrame,
    exemplars: DataFrame | None = None,
    vectors: DataFrame | None = None,
    charts: DataFrame | None = None,
    ascii_only: bool = False,
) -> DataFrame:
    """One suggestion per asset (asset_id, path, kind, text, width, height, exif_original, exif_modified).

    folders: folder, used_count, first_seen. rules: pattern, folder. exemplars and vectors feed the
    semantic match, charts (asset_id, is_chart) the chart rule. ascii_only is that of the keyword search.
    """
    readable = F.when(is_document("kind") | (F.col("kind") == "image"), F.coalesce("text", F.lit(""))).otherwise("")
    a = assets.withColumn("text", readable).withColumn("filename", file_name("path"))
    fuzzy = match_known_folders(a.select("asset_id", "text", "filename"), folders).select(
        "asset_id", F.col("folder").alias("fuzzy_folder"), F.col("confidence").alias("fuzzy_conf"))
    a = with_keyword_category(a, "text", ascii_only).drop("keyword_hits").withColumn("hint", F.when(
        F.col("kind") == "image", picture_hint("filename", "width", "height", "exif_original", "exif_modified")))
    if exemplars is not None and vectors is not None:
        with_words = a.select("asset_id", "kind", has_text("text", K.MATCH_MIN_CHARS).alias("has_words"))
        q = vectors.join(with_words, "asset_id").filter(
            ((F.col("modality") == "image") & (F.col("kind") == "image"))
            | ((F.col("modality") == "text") & F.col("has_words"))).select("asset_id", "modality", "vec")
        sem = X.decide(X.combined_scores(q, X.purge_name_only(exemplars), 2)).select(
            "asset_id", F.col("folder").alias("sem_folder"), F.col("confidence").alias("sem_conf"),
            F.col("reason").alias("sem_reason"))
        a = a.drop("text").join(sem, "asset_id", "left")
    else:
        a = a.drop("text").withColumn("sem_folder", F.lit(None).cast("string")).withColumn(
            "sem_conf", F.lit(None).cast("double")).withColumn("sem_reason", F.lit(None).cast("string"))
    a = a.join(fuzzy, "asset_id", "left")
    a = a.join(charts, "asset_id", "left") if charts is not None else a.withColumn("is_chart", F.lit(False))
    # only signatures of this list can match, so at most as many rules are broadcast
    rules = F.broadcast(rules.filter(F.col("pattern").isin(known_signatures())))
    a = with_learned(a, rules, F.concat(F.lit("keyword:"), "keyword_category"), "rule_keyword")
    a = with_learned(a, rules, F.lit("chart_trading"), "rule_chart")
    a = with_learned(a, rules, F.concat(F.lit("heur:"), F.col("hint.category")), "rule_hint")
    return cascade(a)


def sample_training_files(files: DataFrame, per_folder: int = K.IMPORT_PER_FOLDER, seed: int = 0) -> DataFrame:
    """At most eight files per label, drawn at random but the same for the same seed."""
    draw = [F.sha2(F.concat_ws("|", "path", F.lit(str(seed))), 256).asc(), F.col("path").asc()]
    return top_per_group(files, ["label"], draw, per_folder, "draw").drop("draw")


def learnable(labelled: DataFrame) -> DataFrame:
    """What a labelled asset (folder, seq, kind, text, image_vec, text_vec) teaches: the picture itself and
    its text, or a document's text if long enough. Videos teach nothing."""
    image = labelled.filter((F.col("kind") == "image") & F.col("image_vec").isNotNull()).select(
        "folder", F.lit("image").alias("modality"), "seq", F.col("image_vec").alias("vec"))
    readable = (F.col("kind") == "image") | is_document("kind")
    text = labelled.filter(readable & has_text("text", K.LEARN_MIN_CHARS) & F.col("text_vec").isNotNull()).select(
        "folder", F.lit("text").alias("modality"), "seq", F.col("text_vec").alias("vec"))
    return image.unionByName(text)


def learn(store: DataFrame, labelled: DataFrame, keep: int | None = None) -> DataFrame:
    """The store with the new examples appended; with keep, cut to the latest so many per folder and modality."""
    grown = store.select("folder", "modality", "seq", "vec").unionByName(learnable(labelled))
    return grown if keep is None else X.latest(grown, keep)


def enrich_missing(assets: DataFrame, cache: DataFrame, encoder: Encoder, schema: str = "fingerprint string, vec array<float>") -> DataFrame:
    """Vectors for the file versions the cache (fingerprint, vec) does not hold yet. The encoder maps
    batches with the assets' columns and fingerprint to batches of the given schema."""
    a = assets.withColumn("fingerprint", cache_fingerprint("path", "mtime", "size"))
    known = cache.select("fingerprint")
    if "asset_id" not in a.columns:  # a plain listing: nothing wide to spare
        return a.join(known, "fingerprint", "left_anti").dropDuplicates(["fingerprint"]).mapInPandas(encoder, schema)
    # versions are picked by narrow keys; contents and texts meet the picked ids only and are never grouped
    todo = (a.select("fingerprint", "asset_id").join(known, "fingerprint", "left_anti")
            .groupBy("fingerprint").agg(F.min("asset_id").alias("asset_id")).select("asset_id"))
    return a.join(todo, "asset_id", "left_semi").mapInPandas(encoder, schema)


def tag_vectors(spark: SparkSession, encoder: Encoder, tags: list[str] | None = None) -> DataFrame:
    """(tag, tag_ord, vec) of the candidate tags by the caller's encoder, which maps (tag, tag_ord, model_input) batches
    to (tag, tag_ord, vec). Write the result to a store: the tags do not change between runs."""
    rows = [(t, i) for i, t in enumerate(K.TAGS if tags is None else tags)]
    named = spark.createDataFrame(rows, "tag string, tag_ord int").withColumn("model_input", tag_input("tag"))
    return named.mapInPandas(encoder, "tag string, tag_ord int, vec array<float>")


def seed_folder_names(store: DataFrame, folders: DataFrame, encoder: Encoder) -> DataFrame:
    """Text examples out of the names of folders that have no text example yet. The encoder maps
    (folder, model_input) batches to (folder, vec)."""
    have = store.filter("modality = 'text'").select("folder").distinct()
    name = F.translate("folder", "/\\", "  ")
    todo = folders.select("folder").distinct().join(have, "folder", "left_anti").select(
        "folder", passage_input(name).alias("model_input")).filter("model_input IS NOT NULL")
    vec = todo.mapInPandas(encoder, "folder string, vec array<float>")
    return vec.select("folder", F.lit("text").alias("modality"), F.lit(0).cast("long").alias("seq"), "vec")


def move_plan(assignments: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """(asset_id, src, dest, folder) for (asset_id, path, folder); files without a folder stay."""
    a = assignments.filter(F.coalesce("folder", F.lit("")) != "").select(
        "asset_id", F.col("path").alias("src"), "folder",
        join_folder(F.lit(root), "folder").alias("dest_dir"), file_name("path").alias("name"))
    named = free_names(a.select("asset_id", "dest_dir", "name"), existing)
    return a.join(named.select("asset_id", "new_name"), "asset_id").select(
        "asset_id", "src", F.concat_ws("/", "dest_dir", "new_name").alias("dest"), "folder")


def delete_plan(members: DataFrame) -> DataFrame:
    """Paths to delete: of every group all members but the largest. A file in several groups goes once."""
    return all_but_largest(members).select("asset_id", "path", "size").distinct()


def keywords(assets: DataFrame, vectors: DataFrame, tags: DataFrame, top_n: int = 6) -> DataFrame:
    """(asset_id, rank, keyword): tags for pictures, frequent words for documents, none for the rest."""
    images = assets.filter("kind = 'image'").select("asset_id").join(vectors, "asset_id").select("asset_id", "vec")
    words = frequent_words(assets.filter(is_document("kind")).select("asset_id", "text"), top_n)
    return image_tags(images, tags, top_n).select("asset_id", "rank", F.col("tag").alias("keyword")).unionByName(
        words.select("asset_id", "rank", F.col("word").alias("keyword")))
