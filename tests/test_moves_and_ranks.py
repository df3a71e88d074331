import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwarden.operators import moves, ranking
from stackwarden.plans import filing

NAMES = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_1_1.pdf", "a_3.pdf", "b", "b_1", "b_1_2", ".x", ".x_1", "c.tar.gz", "c.tar_1.gz", "a_02.pdf"]


def one_by_one(movers, existing):
    taken, out = set(existing), {}
    for i, d, n in sorted(movers):
        p, new, k = PurePosixPath(n), n, 0
        while (d, new) in taken:
            k += 1
            new = f"{p.stem}_{k}{p.suffix}"
        taken.add((d, new))
        out[i] = new
    return out


@pytest.mark.parametrize("seed,rows_per_task,per_step", [(0, 10**6, 4000), (2, 0, 4000), (3, 10**6, 1)])
def test_free_names_equal_the_sequential_rule(spark, seed, rows_per_task, per_step):
    rnd = random.Random(seed)
    dirs = [f"/d{k}" for k in range(12)]
    movers = [(i, rnd.choice(dirs), rnd.choice(NAMES)) for i in rnd.sample(range(1000), 260)]
    existing = {(rnd.choice(dirs), rnd.choice(NAMES)) for _ in range(30)}
    m = spark.createDataFrame(movers, "asset_id long, dest_dir string, name string")
    e = spark.createDataFrame(sorted(existing), "dest_dir string, name string")
    got = {r.asset_id: r.new_name for r in moves.free_names(m, e, rows_per_task, per_step).collect()}
    assert got == one_by_one(movers, existing)


def test_free_names_without_contest(spark):
    m = spark.createDataFrame([(3, "/d", "x.png"), (1, "/d", "x.png"), (2, "/e", "x.png")], "asset_id long, dest_dir string, name string")
    e = spark.createDataFrame([("/e", "x.png")], "dest_dir string, name string")
    got = {r.asset_id: r.new_name for r in moves.free_names(m, e).collect()}
    assert got == {1: "x.png", 3: "x_1.png", 2: "x_1.png"}


def test_move_plan_leaves_out_files_without_folder(spark):
    a = spark.createDataFrame([(1, "/s/a.txt", "X\\Y"), (2, "/s/b.txt", ""), (3, "/s/c.txt", None)], "asset_id long, path string, folder string")
    e = spark.createDataFrame([], "dest_dir string, name string")
    assert [tuple(r) for r in filing.move_plan(a, e, "/root/").collect()] == [(1, "/s/a.txt", "/root/X/Y/a.txt", "X\\Y")]


def test_places_by_range_sort_equal_a_window(spark):
    df = spark.range(5000).select((F.col("id") % 7 % 3).alias("g"), (F.col("id") * 37 % 11).alias("v"), "id")
    df = df.withColumn("g", F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("g")))  # half in one group
    order = [F.col("v").desc(), F.col("id").asc()]
    want = df.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(*order)))
    got = ranking.place_in_group(df, ["g"], order, rows_per_task=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_global_positions_and_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = [r for r in ranking.page_of(df, [F.col("v").asc()], 50).orderBy("v").collect()]
    assert [r.position for r in got] == list(range(1000)) and got[-1].page_no == 20
    page2 = ranking.one_page(df, [F.col("v").asc()], 2, 50).collect()
    assert [r.v for r in page2] == [r.v for r in got[50:100]]
