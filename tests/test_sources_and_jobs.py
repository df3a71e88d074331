import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from stackwarden.functions.hashing import average_hash
from stackwarden.operators.ranking import top_per_group
from stackwarden.plans import duplicates, filing
from stackwarden.session import shared_dir
from stackwarden.sources import files, ids, ranges, stores, texts
from stackwarden.streaming import arrivals

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tree():
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    data = {"red1.png": b"A" * 2000, "red2.png": b"A" * 2000, "red3.png": b"B" * 2100, "blue.png": b"C" * 2000, "tiny.png": b"D" * 200,
            "sub/doc.PDF": b"E" * 3000, "sub/deep/x.docx": b"F" * 1500, "note.txt": b"G" * 5000, ".git/h.png": b"H" * 2000}
    for name, content in data.items():
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        with open(f"{d}/{name}", "wb") as f:
            f.write(content)
    return d


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_scans(spark, tree):
    assert names(files.scan_for_duplicates(spark, [tree])) == ["blue.png", "doc.PDF", "red1.png", "red2.png", "red3.png", "x.docx"] + ([] if "h.png" not in names(files.scan_for_duplicates(spark, [tree])) else ["h.png"])
    assert "tiny.png" in names(files.scan_for_filing(spark, tree))
    flat = files.scan_for_grouping(spark, [tree], files=[f"{tree}/note.txt", f"{tree}/red1.png"], recursive=False)
    assert names(flat) == ["blue.png", "note.txt", "red1.png", "red2.png", "red3.png", "tiny.png"]
    labels = {os.path.basename(r.path): r.label for r in files.scan_training_tree(spark, tree).collect()}
    assert labels["x.docx"] == "sub/deep" and labels["doc.PDF"] == "sub" and "red1.png" not in labels
    assert [r.folder for r in files.first_level_folders(files.listing(spark, [tree]), [tree]).collect()] == ["sub"]
    ids = files.numbered(files.listing(spark, [tree])).orderBy("path").collect()
    assert [r.asset_id for r in ids] == list(range(len(ids)))


def test_scan_reads_no_bytes_and_pushes_the_size_test(spark, tree):
    plan = files.scan_for_duplicates(spark, [tree])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "GreaterThanOrEqual(length,1024)" in plan


def test_duplicates_of_real_files(spark, tree):
    a = files.numbered(files.contents(spark, [tree]).filter("path like '%.png' and path not like '%.git%'"))
    groups = duplicates.exact_duplicates(a).collect()
    assert [(g.n_members, g.recoverable_bytes) for g in groups] == [(2, 2000)]
    ramp = F.array(*[F.lit(float(i % 8)) for i in range(64)])
    other = F.array(*[F.lit(float(-(i // 8))) for i in range(64)])
    hashes = a.select("asset_id", average_hash(F.when(F.col("path").endswith("blue.png"), other).otherwise(ramp)).alias("a_hash"))
    near = duplicates.duplicate_members(a, near=True, hashes=hashes)
    quasi = near.filter("kind = 'quasi'")
    assert names(quasi) == ["red1.png", "red2.png", "red3.png"] and {r.match_pct for r in quasi.collect()} == {100}
    gone = spark.createDataFrame([(f"{tree}/red1.png",)], "path string")
    assert duplicates.exact_duplicates(a, exclude=gone).count() == 0


def test_text_and_sheet_assembly(spark):
    p = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "asset_id long, part_no long, text string")
    assert texts.assemble_text(p).first().text == "a\nb\n" and texts.assemble_text(p, 2).first().text == "a\n"
    c = spark.createDataFrame([(1, 0, "S", 1, 0, "x"), (1, 0, "S", 1, 1, "  "), (1, 0, "S", 1, 2, "y"), (1, 1, "T", 1, 0, None)],
                              "asset_id long, sheet_no int, sheet string, row_no long, col_no int, value string")
    assert texts.assemble_sheets(c).first().text == "[Feuille: S]\nx | y\n[Feuille: T]"


def test_hashed_files_leave_their_bytes_in_the_scan(spark, tree):
    h = files.hashed(spark, [tree])
    assert "content" not in h.columns
    a = files.numbered(files.contents(spark, [tree]))
    want = {(g.n_members, g.digest) for g in duplicates.exact_duplicates(a).select("n_members", F.col("rep_hash").alias("digest")).collect()}
    assert {(g.n_members, g.rep_hash) for g in duplicates.exact_duplicates(h).collect()} == want
    assert files.unreadable(spark, [tree], h).count() == 0
    assert files.unreadable(spark, [tree], h.limit(1)).count() == h.count() - 1


def test_quick_hashes_read_head_and_tail_only(spark, tree):
    with open(f"{tree}/big.mp4", "wb") as f:
        f.write(b"h" * 40_000 + b"m" * 5_000_000 + b"t" * 40_000)
    listed = files.listing(spark, [tree])
    got = {r.path: r for r in ranges.with_quick_hash(listed).collect()}
    assert {p.rsplit("/", 1)[1]: r.bytes_read for p, r in got.items()} == {r.path.rsplit("/", 1)[1]: min(r.size, 32_768) for r in listed.collect()}
    want = {r.path: r.quick_hash for r in duplicates.D.with_quick_hash(files.contents(spark, [tree], min_bytes=0)).collect()}
    assert {p: r.quick_hash for p, r in got.items()} == want
    d = {r.path: r.digest for r in ranges.content_digests(listed, 1 << 20).collect()}
    for r in listed.collect():
        with open(r.path, "rb") as f:
            data = f.read()
        parts = [hashlib.sha256(data[i:i + (1 << 20)]) for i in range(0, max(1, len(data)), 1 << 20)]
        assert d[r.path] == (parts[0] if len(parts) == 1 else hashlib.sha256(b"".join(p.digest() for p in parts))).hexdigest()


def test_files_over_2_gib(spark, tree):
    """Two equal ones, one that differs in the middle only, and small ones beside them."""
    for name, at in (("a.mp4", 0), ("b.mp4", 0), ("c.mp4", 1 << 30)):
        with open(f"{tree}/{name}", "wb") as f:
            f.truncate((1 << 31) + 12_345)
            f.seek(at)
            f.write(b"x" if at else b"")
    h = files.hashed(spark, [tree])
    groups = duplicates.exact_duplicates(h.filter("path like '%.mp4'")).collect()
    assert [(g.n_members, g.recoverable_bytes) for g in groups] == [(2, (1 << 31) + 12_345)]
    with_digest = {os.path.basename(r.path) for r in h.filter("digest is not null").collect()}
    assert with_digest == {"a.mp4", "b.mp4", "c.mp4", "red1.png", "red2.png"}
    assert files.unreadable(spark, [tree], h).count() == 0


def test_files_that_shrink_or_go_are_left_out(spark, tree):
    gone = spark.createDataFrame([(f"{tree}/red1.png", 2000), (f"{tree}/red2.png", 9000), (f"{tree}/none.png", 2000)], "path string, size long")
    assert {os.path.basename(r.path): r.quick_hash is None for r in ranges.with_quick_hash(gone).collect()} == {"red1.png": False, "red2.png": True, "none.png": True}
    assert names(ranges.content_digests(gone)) == ["red1.png"]


def test_huge_files_spread_over_tasks(spark):
    one = spark.createDataFrame([("/a/huge.mkv", 10 << 40)], "path string, size long")
    b = ranges.blocks(one)
    assert b.count() == (10 << 40) // ranges.BLOCK_BYTES
    sizes = b.repartition("path", "block").withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count"), F.min("count")).first()
    assert sizes[0] < 1.2 * sizes[1]


def test_ids_of_paths_last(spark):
    """Five scans with files that come and go, in small gaps: ids stay within an epoch and keep the order of paths."""
    rnd = random.Random(3)
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    known, there, epochs = {}, set(), []
    dictionary = ids.PathIds(spark, f"{d}/ids", step=64)
    for scan in range(5):
        there = {p for p in there if rnd.random() < 0.8} | {f"/a/{rnd.randrange(400):03d}{rnd.choice(['', '/x', 'é'])}.png" for _ in range(60)}
        got = dictionary.number(spark.createDataFrame([(p, 1) for p in sorted(there, key=lambda _: rnd.random())], "path string, size int").repartition(3)).collect()
        mine = {r.path: r.asset_id for r in got}
        assert mine.keys() == there and {r.kind for r in got} == {"image"}
        if epochs and dictionary.epoch() > epochs[-1]:
            moved = {r.asset_id: r.now for r in dictionary.renamed(epochs[-1]).collect()}
            known = {p: moved.get(i, i) for p, i in known.items()}
        epochs.append(dictionary.epoch())
        assert all(known.get(p, i) == i for p, i in mine.items())
        known |= mine
        order = sorted(known, key=lambda p: p.encode())
        assert [known[p] for p in order] == sorted(set(known.values()))
    assert epochs[0] == 0 and {r.path for r in dictionary.load().collect()} == set(known)
    again = dictionary.number(spark.createDataFrame([(p, 1) for p in there], "path string, size int")).collect()
    assert {r.path: r.asset_id for r in again} == {p: known[p] for p in there} and dictionary.epoch() == epochs[-1]


def test_ids_are_labelled_anew_where_there_is_no_room(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    dictionary = ids.PathIds(spark, f"{d}/ids", step=2)
    of = lambda *names: {r.path: r.asset_id for r in dictionary.number(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert of("/a", "/c") == {"/a": 2, "/c": 4} and of("/a", "/b", "/c") == {"/a": 2, "/b": 3, "/c": 4} and dictionary.epoch() == 0
    assert of("/a", "/aa", "/b") == {"/a": 2, "/aa": 4, "/b": 6} and dictionary.epoch() == 1
    assert {r.asset_id: r.now for r in dictionary.renamed(0).collect()} == {3: 6, 4: 8} and of() == {}


def test_stores(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = stores.ExemplarStore(spark, f"{root}/ex")
    assert store.load().count() == 0
    rows = [("F", "image", i, [float(i)]) for i in range(60)]
    store.save(spark.createDataFrame(rows, "folder string, modality string, seq long, vec array<float>"))
    assert sorted(r.seq for r in store.load().collect()) == list(range(60))
    store.save(filing.learn(store.load(), spark.createDataFrame(
        [("F", 99, "image", "long enough text here", [1.0], [2.0]), ("F", 98, "video", "long enough text here", [1.0], [2.0]), ("G", 97, "pdf", "short", None, [2.0])],
        "folder string, seq long, kind string, text string, image_vec array<float>, text_vec array<float>")))
    got = {(r.folder, r.modality): r.n for r in store.load().groupBy("folder", "modality").agg(F.count("*").alias("n")).collect()}
    assert got == {("F", "image"): 61, ("F", "text"): 1}
    newest = filing.learn(store.load(), spark.createDataFrame([], "folder string, seq long, kind string, text string, image_vec array<float>, text_vec array<float>"), keep=50)
    assert sorted(r.seq for r in newest.filter("modality = 'image'").collect()) == list(range(11, 60)) + [99]
    store.drop_old(keep=1)
    assert len(store.versions()) == 1
    log = stores.rule_store(spark, f"{root}/rules")
    for k, folder in enumerate(["A", "B"]):
        log.append(spark.createDataFrame([("p", folder, None, k)], "pattern string, folder string, updated_at timestamp, seq long"))
    assert [tuple(r) for r in stores.learned_rules(log).collect()] == [("p", "B")]
    for fmt in ("parquet", "json", "csv"):
        stores.write_result(spark.range(3), f"{root}/out-{fmt}", fmt)
        assert spark.read.format(fmt).option("header", "true").load(f"{root}/out-{fmt}").count() == 3
    with pytest.raises(ValueError):
        stores.write_result(spark.range(1), f"{root}/x", "xml")


def test_enrichment_is_idempotent(spark):
    a = spark.range(10).select(F.concat(F.lit("/f"), "id").alias("path"), F.lit(0).cast("timestamp").alias("mtime"), F.lit(5).alias("size"))

    def encoder(batches):
        for b in batches:
            yield b[["fingerprint"]].assign(vec=[[1.0]] * len(b))

    cache = stores.vector_cache(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/cache")
    for _ in range(2):
        cache.append(filing.enrich_missing(a, cache.read(), encoder))
    assert cache.read().count() == 10
    assert filing.enrich_missing(a.withColumn("size", F.lit(6)), cache.read(), encoder).count() == 10


def test_streams_over_several_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    now = {"availableNow": True}
    schema = "move_id long, ts timestamp, folder string"
    for part in ([(1, "A"), (2, "B")], [(2, "B"), (3, "A")]):
        df = spark.createDataFrame(part, "move_id long, folder string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
        df.select("move_id", "ts", "folder").coalesce(1).write.mode("append").parquet(f"{root}/moves")
        s = spark.readStream.schema(schema).parquet(f"{root}/moves")
        arrivals.count_folders(s, f"{root}/counts", f"{root}/cp1", trigger=now).awaitTermination()
    assert {r.folder: r.used_count for r in arrivals.current_counts(spark, f"{root}/counts").collect()} == {"A": 2, "B": 1}
    schema = "asset_id long, path string, size long, content binary"
    for part in ([(1, b"x"), (2, b"x"), (3, b"y")], [(4, b"y"), (5, b"z")], [(6, b"z"), (7, b"x")]):
        df = spark.createDataFrame([(i, f"/p{i}", len(c), bytearray(c)) for i, c in part], schema)
        df.coalesce(1).write.mode("append").parquet(f"{root}/files")
        s = spark.readStream.schema(schema).parquet(f"{root}/files")
        arrivals.duplicates_on_arrival(s, f"{root}/index", f"{root}/dups", f"{root}/cp2", now).awaitTermination()
    found = spark.read.parquet(f"{root}/dups/found")
    assert {r.asset_id: r.first_id for r in found.collect()} == {2: 1, 4: 3, 6: 5, 7: 1}


def test_late_moves_count_and_logs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(arrivals.BatchLog, "COMPACT_EVERY", 2)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "move_id long, ts timestamp, folder string"
    for k in range(7):
        day = "2020-01-01" if k == 5 else f"2024-01-{k + 1:02d}"
        part = [(k, "A"), (max(0, k - 2), "A"), (100 + k, "B")]
        df = spark.createDataFrame(part, "move_id long, folder string").withColumn("ts", F.lit(day).cast("timestamp"))
        df.select("move_id", "ts", "folder").coalesce(1).write.mode("append").parquet(f"{root}/moves")
        s = spark.readStream.schema(schema).parquet(f"{root}/moves")
        arrivals.count_folders(s, f"{root}/counts", f"{root}/cp", {"availableNow": True}).awaitTermination()
    assert {r.folder: r.used_count for r in arrivals.current_counts(spark, f"{root}/counts").collect()} == {"A": 7, "B": 7}
    left = stores.committed(spark, f"{root}/counts/log")
    assert [n for n in left if n.startswith("base")] == ["base-000000000004", "base-000000000006"]
    assert min(n for n in left if n.startswith("batch")) == "batch-000000000004"


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = top_per_group(df, ["g"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_flagship_moves_hashes_not_bytes(spark):
    df = spark.createDataFrame([(1, "/a", 3, bytearray(b"abc"))], "asset_id long, path string, size long, content binary")
    df.write.parquet(out := tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t")
    plan = duplicates.exact_duplicates(spark.read.parquet(out))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("sha2(content") <= 1


def test_shared_folder_comes_from_the_session(spark):
    assert os.path.isdir(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)


def _tables_in_folders(spark, texts):
    """sf0.001 with other documents, stored as a folder of several files."""
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", f"{d}/{name}")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_arriving_duplicates_of_a_folder_of_files(spark):
    d = _tables_in_folders(spark, ["a", "b", "a", "c", "b", "a"])
    got = queries()["arriving_duplicates"](spark, d).collect()
    assert {r.asset_id: r.first_id for r in got} == {2: 0, 4: 1, 5: 0}


def test_arriving_suggestions_of_a_folder_of_files(spark):
    d = _tables_in_folders(spark, ["a", "b", "a", "c"])
    got = queries()["arriving_suggestions"](spark, d).collect()
    assert {r.asset_id: r.category for r in got} == {0: "Other", 1: "Bank", 2: "Forex", 3: "Other"}


def test_groups_of_one_kind_are_of_documents_alone(spark):
    big = "x" * 1100
    d = _tables_in_folders(spark, [big if i in (0, 10) else f"{i}" * 1100 for i in range(12)])
    got = queries()["groups_of_one_kind"](spark, d).collect()
    assert [tuple(r) for r in got] == [(0, 2, 1100)]


def test_a_listing_of_many_small_files_makes_few_tasks(spark, tmp_path):
    from stackwarden.sources import files

    for i in range(1500):
        (tmp_path / f"{i}.pdf").write_bytes(b"x" * (1 + i % 3))
    listed = files.listing(spark, [str(tmp_path)])
    assert listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 1500 // 32
    assert sorted((r.path, r.size) for r in listed.collect()) == sorted((str(tmp_path / f"{i}.pdf"), 1 + i % 3) for i in range(1500))


def test_a_listing_has_hidden_and_empty_files_and_is_no_list_of_the_driver(spark, tmp_path):
    from stackwarden.sources import files, folders

    for name in ("_draft.pdf", ".x/a.pdf", "empty.pdf", "sub/deep/b [1].pdf", "sub/ü %20.pdf", "k=v/c.pdf"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.pdf" else name.encode())
    os.symlink(tmp_path, tmp_path / "sub" / "back")
    os.symlink(tmp_path / "none", tmp_path / "broken")
    there = {str(p): (p.stat().st_size, p.stat().st_mtime_ns // 1_000_000) for p in tmp_path.rglob("*") if p.is_file() and "back" not in p.parts}
    listed = files.listing(spark, [str(tmp_path)])
    assert {r.path: (r.size, r.mtime) for r in listed.select("path", "size", F.unix_millis("mtime").alias("mtime")).collect()} == there and len(there) == 6
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan.replace(shared_dir(spark), "")  # the files are rows, not inputs
    assert names(files.listing(spark, [str(tmp_path), str(tmp_path)], recursive=False)) == ["_draft.pdf", "empty.pdf"]
    assert names(files.listing(spark, [f"file:{tmp_path}/s*/", f"{tmp_path}/empty.pdf"])) == ["b [1].pdf", "empty.pdf", "ü %20.pdf"]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, [f"{tmp_path}/none"])
    assert {r.path: bytes(r.content) for r in files.contents(spark, [str(tmp_path)], min_bytes=0).collect()} == {p: open(p, "rb").read() for p in there}
    level = sorted((p.replace("file://", ""), n, f) for p, n, _, f in folders.store_entries(f"file://{tmp_path}/sub"))
    assert level == [(f"{tmp_path}/sub/back", 0, True), (f"{tmp_path}/sub/deep", 0, True), (f"{tmp_path}/sub/ü %20.pdf", len("sub/ü %20.pdf".encode()), False)]


def test_grouping_scan_of_texts_that_are_empty_or_missing_equals_sql(spark):
    from __spark_entry__ import oracle_sql
    from check_oracle import oracle_rows, rows_of

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(0, "", "en", "web", 0), (1, None, "en", "web", 0), (2, "x" * 2000, "", "web", 2000), (3, "é", "fr", "_src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/t")
    os.symlink(next(f"{d}/t/{n}" for n in os.listdir(f"{d}/t") if n.endswith(".parquet")), f"{d}/documents.parquet")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", f"{d}/{name}")
    for query in ("grouping_scan", "file_hashes"):
        df = queries()[query](spark, d)
        want_names, want = oracle_rows(d, oracle_sql()[query])
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and sorted(df.columns) == sorted(want_names)
