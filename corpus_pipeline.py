"""The corpus pipeline: documents in, packed token sequences out. Each stage applies one operator of stackwarden.llm."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwarden.llm import langid, packing, quality, resemblance, suffixes
from stackwarden.llm.common import prepare, whole_rows
from stackwarden.llm.queries import vocabulary
from stackwarden.session import delete_paths, fresh_path, recorded_paths


# Of texts in the suffix stage: with passages of words beside bytes, a block takes twice the memory it takes in op5
BLOCK_BYTES = 2 << 20
# Of chunks in the packing stage: its workers share an executor with what the stages before have left in the JVM
KEPT_CHUNKS = 100_000
# What the last stage of a session has left in the shared folder
_left: dict[str, list[str]] = {}


def stage(fn):
    """A stage whose scratch is removed when the next one starts. By then its result has been written; should that stage's
    input still be read from the scratch, the scratch stays."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        app = spark.sparkContext.applicationId
        old = _left.pop(app, [])
        names = {p.rstrip("/").rsplit("/", 1)[1] for p in old}
        if names and not any(part in names for f in docs.inputFiles() for part in f.split("/")):
            delete_paths(spark, old)
        with recorded_paths() as paths:
            out = fn(spark, docs, sf_dir)
        _left[app] = paths
        return out

    return run


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in known languages, one or several, by a model fitted on their own labels. Undetermined ones go, and
    so do texts that the languages found in them explain worse than no language at all: those in languages nobody labelled,
    and what is no language. Where no document has a label, nothing can be told and all texts with a letter stay."""
    model = langid.fit(docs)
    rows = langid.predict(whole_rows(docs), model, "row", "text")
    if not model.langs:
        return rows.filter(F.col("text").rlike(r"\p{L}")).select("row.*")
    return rows.filter((F.col("lang_pred") != langid.UNDETERMINED) & F.col("explained")).select("row.*")


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the weakly supervised rules find good. A null or empty text has no words and goes; equal rows
    all stay or all go; the columns stay as they are."""
    return quality.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of texts that share 0.8 or more of their five-word
    shingles. op8's contract (three words, three bits) is for that query alone. Wordless texts, null or not, are one
    component; of rows that share their doc_id and text one stays; of a component's rows without doc_id one stays too."""
    return resemblance.keep_one(docs, words=5, similarity=0.8)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words, and of 400 bytes and more, that occur again. Characters cut in part stay whole; n_chars follows."""
    cut = suffixes.remove_repeats(docs, words=51, block_bytes=BLOCK_BYTES)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents; one row per piece. A null or empty text is its end id; repeated rows and rows
    without doc_id are packed like all others. No documents give no pieces."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, kept_chunks=KEPT_CHUNKS)


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack_sequences),
]

# Mixtures of n-grams, suffix comparison and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, step in STAGES:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete_paths(spark, before)
        before = [path]
    return docs
