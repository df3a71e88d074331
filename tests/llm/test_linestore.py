"""Line dedup against plain Python, and the levelled runs by themselves."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stackwarden.llm import linestore
from stackwarden.llm.queries import QUERIES
from stackwarden.session import fresh_path

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, min_chars=20, min_docs=3):
    holders = defaultdict(list)
    keys = [[x.strip(" \t\n\v\f\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in docs]
    for (doc_id, _), own in zip(docs, keys):
        for k in {k for k in own if len(k) >= min_chars}:
            holders[k].append(doc_id)
    last = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for (doc_id, t), own in zip(docs, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own) if k not in last or last[k] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), None if t is None else "\n".join(stay)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(8)
    lines = [f"line number {i} of the pool {'é' * (i % 3)}" for i in range(40)]
    edge = ["x" * 19, "x" * 20, "é" * 19, "é" * 20, " " + "y" * 19, "Z" * 25, "  " + "z" * 25 + "\t"]
    texts = []
    for i in range(150):
        own = [rnd.choice(lines + edge) + rnd.choice(["", " ", "\r"]) for _ in range(rnd.randint(0, 8))] + [f"only in document {i} and no other"]
        rnd.shuffle(own)
        texts.append("\n".join(own))
    texts = [t + "\nThe line that nearly all documents hold" if i % 4 else t for i, t in enumerate(texts)]
    texts += [None, "", "\n", "\n\n", texts[5], texts[5], "the same line again and again\n" * 30_000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    only = "a line that stands in rows without id only"
    return rows + [(None, only), (None, only), (None, only + "\n" + lines[0]), (4000, texts[1]), (4000, texts[1]), (4000, texts[2])]


def values(df):
    return sorted(map(tuple, df.select("row.doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


@pytest.mark.parametrize("batches,fanout,hot", [(6, 3, 1000), (9, 2, 5), (1, 3, 1000)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, fanout, hot):
    monkeypatch.setattr(linestore, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", b"h", 1.5) for r in rows], "doc_id long, text string, node string, h binary, n_lines double").repartition(5)
    got = linestore.drop_lines(docs, batches=batches, fanout=fanout)
    assert values(got) == brute(rows)
    assert got.select("row.*").columns == docs.columns


def test_runs_hold_each_key_once_and_levels_stay_few(spark):
    runs = linestore.LineRuns(spark, fresh_path(spark, "runs"), fanout=2)
    want = defaultdict(list)
    for batch in range(8):
        part = [(k, 100 - 10 * batch - k % 3) for k in range(batch, 60, batch + 1)]
        for k, d in part:
            want[k].append(d)
        runs.add(spark.createDataFrame(part, "k int, doc_id long").select(F.encode(F.col("k").cast("string"), "UTF-8").alias("h"), "doc_id"))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [0, 0, 0, 1]
    got = runs.compact().collect()
    assert len(got) == len(want)
    assert {int(r.h): (min(r.n, 3), r["last"]) for r in got} == {k: (min(len(d), 3), max(d)) for k, d in want.items()}
    runs.close()


def test_a_batch_adds_only_what_the_runs_do_not_settle(spark):
    runs = linestore.LineRuns(spark, fresh_path(spark, "runs"))
    runs.add(spark.createDataFrame([(b"a", 9), (b"a", 8), (b"a", 7), (b"b", 9)], "h binary, doc_id long"))
    runs.add(spark.createDataFrame([(b"a", 5), (b"b", 5), (b"c", 5)], "h binary, doc_id long"))
    assert sorted(bytes(r.h) for r in spark.table(runs.levels[0][1]).collect()) == [b"b", b"c"]
    runs.add(spark.createDataFrame([(b"a", 20)], "h binary, doc_id long"))
    assert {bytes(r.h): r["last"] for r in runs.compact().collect()} == {b"a": 20, b"b": 9, b"c": 5}
    runs.close()


def test_plan_reads_runs_without_shuffle_or_sort(spark):
    runs = linestore.LineRuns(spark, fresh_path(spark, "runs"))
    runs.add(spark.createDataFrame([(bytes([i]), i) for i in range(200)], "h binary, doc_id long"))
    t = spark.table(runs.names()[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.join(t.select(F.col("h").alias("of")), F.col("h") == F.col("of"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan
    runs.close()


def test_empty_table_and_query(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linestore.drop_lines(none).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_lines"](spark, str(tmp_path)).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
