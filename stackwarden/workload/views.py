"""Asset tables derived from the supplied tables. `sqlviews` states the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import average_hash
from ..functions.paths import hamming_radius, kind_of
from ..functions.vectors import as_double, unit
from ..session import spread

COPY = 1_000_000  # derived copies get ids from here on
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(t) if name == "documents" else t


def _doc_columns() -> list[Column]:
    i = F.col("doc_id")
    ext = F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".docx").otherwise(".xlsx")
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("_"), i.cast("string"), ext)
    return [i.alias("asset_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"),
            F.timestamp_seconds(F.lit(1577836800) + i * 61).alias("mtime"), "text"]


def assets(spark, d) -> DataFrame:
    """Documents as files."""
    a = table(spark, d, "documents").select(*_doc_columns())
    return a.withColumn("kind", kind_of("path")).withColumn("content", F.encode("text", "UTF-8"))


def near_texts(spark, d) -> DataFrame:
    """Documents, and for every tenth a shouted copy with doubled spaces."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    copy = docs.filter("doc_id % 10 = 0").select(
        (F.col("doc_id") + COPY).alias("doc_id"), F.replace(F.translate("text", _LETTERS, _LETTERS.upper()), F.lit(" "), F.lit("  ")).alias("text"), "lang", "source")
    a = docs.unionByName(copy).select(*_doc_columns())
    return a.withColumn("kind", kind_of("path")).withColumn("content", F.encode("text", "UTF-8"))


def pictures(spark, d) -> DataFrame:
    """Embeddings read as 8x8 grey images, and for every fifth a copy some bits away."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"), average_hash("embedding").alias("a_hash"))
    flip = F.expr("shiftleft(1L, cast(asset_id % 6 as int)) - 1")
    copy = e.filter("asset_id % 5 = 0").select((F.col("asset_id") + COPY).alias("asset_id"), F.col("a_hash").bitwiseXOR(flip).alias("a_hash"))
    p = e.unionByName(copy)
    i = F.col("asset_id")
    path = F.concat(F.lit("/pics/"), F.when(i % 3 == 0, "Screenshot_").otherwise("img_"), i.cast("string"), F.lit(".png"))
    p = p.withColumn("path", path).withColumn("size", 20000 + i * 7919 % 50000).withColumn("kind", kind_of("path"))
    return p.withColumn("radius", hamming_radius("path"))


def vectors(spark, d) -> DataFrame:
    """Embeddings as unit vectors of pictures, videos and documents, every fifth with a shifted copy."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"), as_double("embedding").alias("vec"))
    i = F.col("asset_id")
    shifted = F.transform("vec", lambda x, k: x + F.when((k + 1) % 8 == i % 8, 0.06 * (1 + i % 6)).otherwise(0.0))
    copy = e.filter("asset_id % 5 = 0").withColumn("vec", shifted).withColumn("asset_id", i + COPY)
    v = e.unionByName(copy).select("asset_id", unit("vec").alias("vec"))
    ext = F.when(i % 4 == 2, ".pdf").when(i % 4 == 3, ".mp4").otherwise(".jpg")
    v = v.withColumn("path", F.concat(F.lit("/mix/f"), i.cast("string"), ext)).withColumn("size", 30000 + i * 104729 % 900000)
    return v.withColumn("kind", kind_of("path"))


def exemplars(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("F"), F.col("label").cast("string")).alias("folder"),
                    F.when(F.col("vec_id") % 2 == 0, "image").otherwise("text").alias("modality"),
                    F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))


def queries_for(spark, d) -> DataFrame:
    """Every embedding as an asset with a picture vector and a text vector, each shifted its own way."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"), as_double("embedding").alias("v"))
    i = F.col("asset_id")

    def shifted(offset: int, step: float, mod: int) -> Column:
        return unit(F.transform("v", lambda x, k: x + F.when((k + 1) % 8 == (i + offset) % 8, step * (1 + i % mod)).otherwise(0.0)))

    image = e.select("asset_id", F.lit("image").alias("modality"), shifted(0, 0.06, 6).alias("vec"))
    text = e.select("asset_id", F.lit("text").alias("modality"), shifted(3, 0.05, 4).alias("vec"))
    return image.unionByName(text)


def moves(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("move_id"), "ts", F.col("event_type").alias("folder"),
                                            F.col("user_id").alias("asset_id"))


RULE_SIGNATURES = ["keyword:Bank", "keyword:CV", "chart_trading", "heur:Photos", "heur:Memes"]


def rule_log(spark, d) -> DataFrame:
    """Rules written over time: five signatures, folders that change."""
    i = F.col("event_id")
    sig = F.element_at(F.array(*[F.lit(s) for s in RULE_SIGNATURES]), (i % 5 + 1).cast("int"))
    return table(spark, d, "events").select(sig.alias("pattern"), F.concat(F.lit("Rules/"), (i % 17).cast("string")).alias("folder"),
                                            F.col("ts").alias("updated_at"), i.alias("seq"))


def part_folders(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("folder")).agg(
        F.count(F.lit(1)).alias("used_count"), F.min("p_partkey").alias("first_seen"))


def part_files(spark, d) -> DataFrame:
    """Files named after parts, every fifth with a misspelt widget."""
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    name = F.when(k % 5 == 0, F.replace(name, F.lit("widget"), F.lit("wdget"))).otherwise(name)
    return table(spark, d, "part").select(k.alias("asset_id"), F.concat("p_type", F.lit(" "), "p_brand").alias("text"),
                                          F.concat(name, F.lit("_"), k.cast("string"), F.lit(".pdf")).alias("filename"))


PHRASES = ["", " iban et solde du compte courant", " metatrader take profit", " whatsapp seen at noon", " total 12,50 tva",
           " invoice number 7 due date", " curriculum vitae skills", " contract clause parties", " executive summary report"]


def keyword_docs(spark, d) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 9 + 1).cast("int"))
    i = F.col("doc_id")
    ext = F.when(i % 4 == 0, ".jpg").when(i % 4 == 1, ".pdf").when(i % 4 == 2, ".docx").otherwise(".mp4")
    a = table(spark, d, "documents").select(i.alias("asset_id"), F.concat(F.lit("/in/"), "source", F.lit("/d"), i.cast("string"), ext).alias("path"),
                                            F.concat("text", phrase).alias("text"))
    return a.withColumn("kind", kind_of("path"))


NAMES = ["Screen Shot %d.png", "capture-%d.png", "ScreenShot%d.png", "WhatsApp Image %d.jpg", "WA%d.jpeg", "Snapchat-%d.jpg",
         "IMG_2021%d.jpg", "DSCN123%d.jpg", "PXL_20210101%d.jpg", "vlcsnap-%d.png", "facebook_%d.jpg", "Insta-%d.jpg", "meme_%d.png",
         "plain%d.jpg", "dims%d.heif", "dated%d.bmp"]


def page_pictures(spark, d) -> DataFrame:
    """A picture per page: each name pattern in turn, and some that only dimensions or a date can tell."""
    i = F.col("page_id")
    k = (i % 16).cast("int")
    fmt = F.element_at(F.array(*[F.lit(n.replace("%d", "#")) for n in NAMES]), k + 1)
    name = F.replace(fmt, F.lit("#"), i.cast("string"))
    w, h = F.when(k == 14, 1080).otherwise(800), F.when(k == 14, 2340).otherwise(600 + i.cast("int") % 400)
    dated = F.when((k == 15) | (i % 4 == 2), F.concat((1985 + i % 40).cast("string"), F.lit(":05:06 07:08:09")))
    return table(spark, d, "pages").select(
        i.alias("asset_id"), F.concat(F.lit("/pics/"), name).alias("path"), name.alias("name"), w.cast("int").alias("width"), h.cast("int").alias("height"),
        dated.alias("exif_original"), F.when(i % 3 == 0, F.lit("2019:01:01 00:00:00")).alias("exif_modified"))


SIZES = [(1080, 1920), (1920, 1080), (2340, 1080), (1440, 2560), (800, 600), (199, 400), (400, 199), (3440, 1440),
         (1170, 2532), (2778, 1284), (1024, 768), (150, 150)]
FOLDERS_OF_FILES = ["users/ann/pics", "users/bob/AppData/Roaming", "srv/node_modules/x", "users/ann/Thumbnails", "data\\.git\\x"]


def order_pictures(spark, d) -> DataFrame:
    """Image metadata per order: dates some of which are malformed, sizes from a list, folders from a list."""
    i = F.col("o_orderkey")
    good = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    exif = F.when(i % 11 == 0, F.lit("n/a")).when(i % 13 == 0, F.concat(F.lit("1890"), F.substring(good, 5, 20))).otherwise(good)
    at = (i % len(SIZES)).cast("int") + 1
    w = F.element_at(F.array(*[F.lit(s[0]) for s in SIZES]), at)
    h = F.element_at(F.array(*[F.lit(s[1]) for s in SIZES]), at)
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS_OF_FILES]), (i % len(FOLDERS_OF_FILES)).cast("int") + 1)
    ext = F.when(i % 7 == 0, ".pdf").when(i % 7 == 1, ".heif").otherwise(".JPG")
    return table(spark, d, "orders").select(
        i.alias("asset_id"), F.concat(F.lit("/"), folder, F.lit("/o"), i.cast("string"), ext).alias("path"),
        (10_000 + i * 97 % 60_000).alias("size"), w.alias("width"), h.alias("height"),
        exif.alias("exif_original"), F.when(i % 22 == 0, F.lit("2005:01:01 00:00:00")).alias("exif_modified"))


def pixels(spark, d) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    black = (F.col("l_orderkey") % 2 == 0) & (n % 2 == 0)

    def channel(x: Column) -> Column:
        return F.when(black, 5).otherwise(x % 256).cast("int")

    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), channel(p * 37).alias("r"),
                                              channel(s * 53 + n * 91).alias("g"), channel(n * 29).alias("b"))


def text_parts(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("part_no"), "text")


def cells(spark, d) -> DataFrame:
    """Conversations as sheets: one per role, a row per turn with the turn number, an empty cell, the text."""
    c = table(spark, d, "conversations")
    no = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2)
    col = F.posexplode(F.array(F.col("turn").cast("string"), F.lit(" "), F.col("text"))).alias("col_no", "value")
    return c.select(F.col("conv_id").alias("asset_id"), no.alias("sheet_no"), F.col("role").alias("sheet"), F.col("turn").alias("row_no"), col)


def label_items(spark, d) -> DataFrame:
    """Items sent for labelling; every ninth could not be prepared."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("asset_id"), "label", (F.col("vec_id") % 9 != 4).alias("valid"))


def replies(batched: DataFrame) -> DataFrame:
    """What a model might answer per batch: groups by label; even batches fenced, every seventh cut off,
    one index out of range each."""
    v = batched.filter("valid")
    name = F.when(F.col("batch_id") % 2 == 0, F.lit("Thème ")).otherwise(F.lit(" theme "))
    g = v.groupBy("batch_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("valid_no")), lambda x: x.cast("string")), ",").alias("ix"))
    g = g.withColumn("js", F.concat(F.lit('{"name":"'), name, F.col("label").cast("string"), F.lit('","indices":['), "ix",
                                    F.when(F.col("label") == 3, F.lit(',99,"x",1.5')).otherwise(""), F.lit("]}")))
    b = g.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "js"))), lambda x: x["js"]), ",").alias("js"))
    text = F.concat(F.lit('{"groups":['), "js", F.lit("]}"))
    text = F.when(F.col("batch_id") % 7 == 0, F.expr("substring(js, 1, 40)")).otherwise(text)
    return b.select("batch_id", F.when(F.col("batch_id") % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(F.concat(F.lit("Voici : "), text)).alias("reply"))


MOVE_NAMES = ["a.pdf", "a.pdf", "a_1.pdf", "b.docx", "a_2.pdf", "a_1_1.pdf", "b.docx", "a_4.pdf", "c", "c_1", "c"]


def movers(spark, d) -> DataFrame:
    """Files to be moved to a folder per source, with names that clash."""
    i = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(n) for n in MOVE_NAMES]), (i * 7 % 11 + 1).cast("int"))
    return table(spark, d, "documents").select(i.alias("asset_id"), F.concat(F.lit("/from/"), i.cast("string"), F.lit("/"), name).alias("path"),
                                               F.concat(F.lit("By source\\"), "source").alias("folder"))


def already_there(spark, d) -> DataFrame:
    """Names already taken in some of the destinations."""
    c = table(spark, d, "documents").select("source").distinct()
    dest = F.concat(F.lit("/sorted/By source/"), "source")
    return c.select(dest.alias("dest_dir"), F.explode(F.when(F.length("source") > 4, F.array(
        F.lit("a_3.pdf"), F.lit("a.pdf"), F.lit("b_1.docx"), F.lit("c_2"))).otherwise(F.array(F.lit("a_1.pdf")))).alias("name"))


def frames(spark, d) -> DataFrame:
    """Three frames per video: an embedding and its neighbours by id."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select(F.floor(F.col("vec_id") / 3).alias("asset_id"), (F.col("vec_id") % 4 != 0).cast("int").alias("mask"), F.col("embedding").alias("vec"))
