import hashlib
import random
import re
import unicodedata
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from __spark_entry__ import queries
from stackwarden import constants as K
from stackwarden.functions import display, hashing, paths, text, vectors

ODD = ["", "Élève Ñandú", "ﬁnal ½ ①", "한글 각 테스트", "ＡＢＣ ｆｕｌｌ", "x̂y", "𝐀𝐛𝐜 😀 é", "İstanbul ΣΑΣ", "ǆ ĳ ŉ", "²³ ™ ℡ ﷺ", "Straße",
       " \x1c\u2003padded\u00a0 ", "a  b\u00a0c\u2028d\x1ee\u3000f" * 6, "short"]


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def samples():
    rnd = random.Random(5)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x1E00, 0x2100), (0x2150, 0x2190), (0x3040, 0x3100), (0xAC00, 0xD7A4), (0xF900, 0xFB10), (0xFE70, 0xFFE0)]
    out = list(ODD)
    for _ in range(300):
        lo, hi = rnd.choice(blocks)
        out.append("".join(chr(rnd.randrange(lo, hi)) for _ in range(12)) + " é plain")
    return [s for s in out if all(unicodedata.category(c) != "Cn" for c in s)]


def test_accents_and_tokens(spark):
    rows = samples()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    t = text.tokens("s", 2)
    got = df.select("i", text.strip_accents_lower("s").alias("p"), text.compact("s").alias("c"), t.alias("t"),
                    text.bigrams(t).alias("b"), text.trim_unicode("s").alias("trim")).collect()
    for r in got:
        p = plain(rows[r.i])
        toks = [x for x in re.split("[^a-z0-9]+", p) if len(x) >= 2]
        assert r.p == p
        assert r.c == re.sub("[^a-z0-9]+", "", p)
        assert r.t == toks and r.b == [a + b for a, b in zip(toks, toks[1:])]
        assert r.trim == rows[r.i].strip()


def test_no_letter_of_the_quick_path_expands():
    many = text._decompositions()[3]
    assert not [a for a, _ in many if 0xBF <= ord(a) <= 0x131]


def test_fingerprint(spark):
    rows = ODD + ["Word  " * 30, "WORD \n" * 30, "x" * 49, "y" * 50]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")

    def model(s, cut=None):
        n = re.sub(r"\s+", " ", (s if cut is None else s[:cut]).lower()).strip()
        return hashlib.sha256(n.encode()).hexdigest() if len(n) >= 50 else None

    for r in df.select("i", text.text_fingerprint("s").alias("f"), text.text_fingerprint("s", 60).alias("c")).collect():
        assert r.f == model(rows[r.i]) and r.c == model(rows[r.i], 60)


def test_keyword_tokens(spark):
    s = "L'Été d'une abeille: the bee's nests, page 12 and pages; aujourd'hui éàü naïve x1y2 Words"
    want = [w for w in re.findall(r"[a-zA-Z][a-zA-Z']{2,}", plain(s)) if w not in set(K.STOPWORDS) and len(w) >= 4]
    assert spark.createDataFrame([(s,)], "s string").select(text.keyword_tokens("s")).first()[0] == want


def test_paths(spark):
    rows = ["/a/b.JPG", "/a/.hidden", "/a/x.tar.gz", "/a/noext", "C:\\d\\e.PdF", "/v/w.MKV", "/v/w.heif", "/a.b/c", "/a/s..docx"]
    df = spark.createDataFrame([(s,) for s in rows], "p string")
    for r in df.select("p", paths.suffix("p").alias("s"), paths.stem(paths.file_name("p")).alias("stem"), paths.kind_of("p").alias("k")).collect():
        py = PurePosixPath(r.p.replace("\\", "/"))
        assert r.s == py.suffix.lower().lstrip(".") and r.stem == py.stem


def test_quick_hash_and_sizes(spark):
    sizes = [1, 1023, 1024, 1152, 32767, 32768, 32769, 100_000, 1280, 3 * 1024**2 + 7]
    rnd = random.Random(1)
    rows = [(i, rnd.randbytes(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, content binary").withColumn("size", F.length("content").cast("long"))
    for r in df.select("i", "size", hashing.quick_hash("content", "size").alias("q"), display.human_size("size").alias("h")).collect():
        c = rows[r.i][1]
        part = c if len(c) <= 32768 else c[:16384] + c[-16384:]
        assert r.q == hashlib.sha256(part + b"|" + str(len(c)).encode()).hexdigest()
        want = f"{r.size} o" if r.size < 1024 else f"{r.size / 1024:.1f} Ko" if r.size < 1024**2 else f"{r.size / 1024**2:.1f} Mo"
        assert r.h == want


def test_hash_and_vector_edges(spark):
    df = spark.createDataFrame([(-1, 0, [3.0, 4.0]), (5, 5, [0.0, 0.0])], "a long, b long, v array<double>")
    r = df.select(hashing.hamming("a", "b"), hashing.hash_label(F.col("a"), F.lit(None).cast("string")), vectors.unit("v")).collect()
    assert (r[0][0], r[0][1], r[0][2]) == (64, "~ffffffffffffffff", [0.6, 0.8])
    assert r[1][0] == 0 and r[1][2] == [0.0, 0.0]
    assert spark.range(1).select(hashing.match_percent(F.lit(2.24))).first()[0] == 96  # 96.5 goes to even
    assert spark.range(1).select(hashing.average_hash(F.array(*[F.lit(float(i)) for i in range(64)]))).first()[0] == 2**32 - 1


def test_sizes_beyond_a_long_and_at_halves_are_shown_as_c_does(spark):
    rnd = random.Random(8)
    sizes = [0, 1023, 1024, 1048575, 1048576, (1 << 63) - 1024, 1 << 63, 9 * 10**20, 2097152**3, 1500104**3, 1718384**3, 1870307**3, 1897709**3]
    sizes += [1024 * i + 256 * j for i in (1, 2, 3, 1023) for j in range(4)] + [(1 << 30) * i + (1 << 27) * j for i in (1, 1023, 1 << 20) for j in range(8)]
    sizes += [rnd.randrange(1 << rnd.randint(1, 80)) for _ in range(2000)]
    df = spark.createDataFrame([(float(x),) for x in sizes] + [(None,)], "b double")
    got = {r.b: r.h for r in df.select("b", display.human_size("b").alias("h")).collect()}
    for x in map(float, sizes):
        want = "%d o" % x if x < 1024 else "%.1f Ko" % (x / 1024) if x < 1024**2 else "%.1f Mo" % (x / 1024**2) if x < 1024**3 else "%.2f Go" % (x / 1024**3)
        assert got[x] == want, x
    assert got[None] is None


def test_human_sizes_of_keys_whose_cube_is_beyond_a_long(spark, tmp_path):
    spark.createDataFrame([(3_000_002,), (2_097_152,), (4,), (5,), (6,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.asset_id: r.label for r in queries()["human_sizes"](spark, str(tmp_path)).collect()}
    assert got == {3_000_002: "%.2f Go" % (3_000_002.0**3 / 2**30), 2_097_152: "%.2f Go" % (2**63 / 2**30), 4: "16 o", 5: "125 o", 6: "6 o"}
