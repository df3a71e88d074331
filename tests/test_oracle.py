"""Every query with SQL gives the rows DuckDB gives."""

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    names, want = oracle_rows(SF, oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_and_names(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_training_sample_is_bounded_and_repeatable(spark):
    a = queries()["training_sample"](spark, SF)
    b = queries()["training_sample"](spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    per = a.groupBy("label").count().collect()
    assert per and all(r["count"] <= 8 for r in per)


ODD = ["é{}", "{}é", "\u0640{}", "{}\u0301", "\xa0{}\xa0", "_{}", "\u4e2d{}", "1{}", "\U0001f600{}", "{}\u017f", "x\u017f{}", "\u0660{}"]
ODD_TEXTS = [None, "", *(o.format(w) for o in ODD for w in ("cv", "iban", "report", "tva", "h4", "skills", "stop loss")),
             "s\u0131gnal", "\u017fignal", "S\u0130GNAL", "x\u017fkills", "\u017folde", "stop\xa0loss", "take\x0bprofit", "total \u0661\u0662,\u0663\u0664",
             "h\u0663", "KIBAN", "\u212a", "diplomé", "diplomés", "COMPÉTENCES", "date d'échéance"]


@pytest.fixture(scope="module")
def odd_tables():
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", f"{d}/{name}")
    n = len(ODD_TEXTS)  # ids divisible by nine get no phrase of the view's own
    pq.write_table(pa.table({"doc_id": pa.array(range(0, 9 * n, 9), pa.int64()), "text": pa.array(ODD_TEXTS, pa.string()), "lang": ["en"] * n,
                             "source": ["web"] * n, "n_chars": pa.array([len(t or "") for t in ODD_TEXTS], pa.int64())}), f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["keyword_categories", "learned_rule_lookup", "category_overview", "filing_stats"])
def test_letters_and_blanks_beyond_ascii(spark, odd_tables, name):
    df = queries()[name](spark, odd_tables)
    names, want = oracle_rows(odd_tables, oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
