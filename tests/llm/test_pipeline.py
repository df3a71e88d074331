"""The corpus pipeline, stage by stage, against plain Python."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from __spark_entry__ import queries

from test_similar import plain_components, plain_fingerprint
from test_suffixes import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    passage = " ".join(rnd.choice(words) for _ in range(90))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(120, 300))) for _ in range(60)]
    texts += texts[:10] + [t + " " + passage for t in texts[20:26]] + [t.replace(" ", "  ", 1) for t in texts[30:34]]
    texts += [None, "", "12 34", "bad bad bad " * 60, "#$% " * 80, "too short"]
    return [(i * 2, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs.collect()
    before = {r[0]: r[1] for r in corpus()}
    known = {r.doc_id for r in seen["language ID"]}
    assert known == {k for k, t in before.items() if t and any(map(str.isalpha, t))}
    good = {r.doc_id: r.text for r in seen["quality rules"]}
    assert good == {k: t for k, t in before.items() if k < 160} and len(good) == 80
    ids = sorted(good)
    roots = plain_components(ids, [plain_fingerprint(good[k]) for k in ids])
    single = {r.doc_id: r.text for r in seen["SimHash near-dedup"]}
    assert single == {k: good[k] for k in set(roots.values())} and len(single) < len(good)
    order = sorted(single)
    cut = {r.doc_id: r for r in seen["suffix-array dedup"]}
    removed = 0
    for k, gone in zip(order, brute([single[k].encode() for k in order], 400)):
        kept = np.frombuffer(single[k].encode(), np.uint8)[~gone].tobytes().decode()
        assert (cut[k].text, cut[k].n_chars, cut[k].source) == (kept, len(kept), f"s{k // 2 % 3}")
        removed += int(gone.sum())
    assert removed > 1000
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in seen["packing"]:
        pieces[r.doc_id].append(r)
    for k, r in cut.items():
        want = np.array(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(p.ids for p in sorted(pieces[k], key=lambda p: p.start)) == want
    again = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in again) == sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in seen["packing"])


def test_registered_and_empty(spark, tmp_path):
    assert {"pipeline"} | {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" if n.startswith("op") else n for n in queries()}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
