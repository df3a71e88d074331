"""The quality stage against the labels of the supplied tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from stackwarden.llm import quality

D = "/root/testdata/sf0.01"


def test_rejected_low_quality_texts_go_and_good_ones_stay(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, D).select("doc_id").collect()}
    rows = quality.judge(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    passed = [r for r in rows if not r.base_failed]
    symbols = {r.doc_id for r in passed if r.v_symbols == -1 and r.label == 0}
    assert len(symbols) > 20 and not symbols & kept
    good = {r.doc_id for r in passed if r.label == 1}
    assert len(good) > 200 and good <= kept


def test_no_rule_turns_round(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    counted = quality.count_votes(quality.with_counts(docs, "doc_id").select(*quality.votes()))
    p = quality.estimate(counted)
    v = [f"v_{name}" for name, *_ in quality.RULES]
    ask = spark.createDataFrame([[1] * 5] + [[-1 if i == j else 1 for i in range(5)] for j in range(5)], ",".join(f"{c} int" for c in v))
    q = [r.q for r in ask.coalesce(1).select(quality.posterior(p).alias("q")).collect()]
    assert all(x < q[0] for x in q[1:])
