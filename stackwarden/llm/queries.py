"""The registered queries of this package: thin wrappers that run an operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import bpe, fingerprints, importance, langid, licenses, linestore, packing, quality, simhash, spelling, suffixes, tokenfiles, warc
from .common import id_and_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register(fn) if fn else register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(sql=licenses.summary_sql())
def op1_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, d, "documents")))


@query(sql=quality.judge_sql())
def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 4).alias("quality"))


@query
def op3_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks, with_text=False).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, d, "documents"))


@query
def op5_suffixes(spark: SparkSession, d: str) -> DataFrame:
    cut = suffixes.remove_repeats(id_and_text(table(spark, d, "documents")), length=400)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), "text")


@query(sql="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
    max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM q""")
def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    path = warc.write(table(spark, d, "pages"), fresh_path(spark, "warc"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


@query
def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "window", "step_group")


@query
def op10_token_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = tokenfiles.write_token_files(docs, fresh_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"), end_id=2)
    rows = tokenfiles.with_checksums(tokenfiles.read_token_files(spark, path))
    return tokenfiles.with_starts(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query(sql=importance.resample_sql())
def op11_importance(spark: SparkSession, d: str) -> DataFrame:
    drawn = importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(sql=spelling.variants_sql(importance.crc32_sql))
def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, d, "documents"), spelling.planted))


@query(sql=linestore.drop_lines_sql())
def op13_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = linestore.drop_lines(id_and_text(table(spark, d, "documents")))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
