"""WARC archives, compressed record by record with a dictionary built from the archive's own records.

Each archive starts with a Zstandard dictionary in a skippable frame (magic 0x184D2A5D) and then holds one frame per
record. It is written by Spark's text writer, whose line separator is an empty skippable frame, so the files lie
wherever Spark can write and readers of Zstandard streams skip the separators. Payloads of `min_bytes` or more that
are equal are stored once: the record with the largest page_id is the response, the others are revisits naming it.

Input: page_id, url, html (null: empty payload). Repeated rows with the response's page_id are responses too; a null
page_id is smaller than any other and its record names none. An empty table gives an empty set of archives. Output of
read: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
DICTIONARY_BYTES = 32 << 10
# Records of an archive that its dictionary is built from: the first ones, up to so many bytes
SAMPLE_BYTES = 1 << 20
SKIPPABLE, DICTIONARY_MAGIC = 0x184D2A50, 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
               "refers_to long")


def marked(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses). Payloads move once, by digest; small ones have
    keys of their own and so spread."""
    payload = F.coalesce(F.encode(pages["html"].cast("string"), "UTF-8"), F.lit(b""))
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("big", F.length("payload") >= min_bytes)
    p = p.withColumn("k", F.when(F.col("big"), F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    first = p.filter("big").groupBy("k").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("of"), "first")
    p = p.join(first, F.col("k") == F.col("of"), "left")
    return p.select("page_id", "url", "payload", "digest", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record."""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    body = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The fields of READ_SCHEMA."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = raw[end + 4:end + 4 + int(head["Content-Length"])]
    kind = head["WARC-Type"]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        n, own = len(body), hashlib.sha1(body).hexdigest()
        if own != digest:
            raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not agree")
    else:
        n, body = int(head["X-Payload-Length"]), None
    number = lambda k: int(head[k]) if k in head else None
    return number("X-Page-ID"), head.get("WARC-Target-URI"), body, n, digest, kind, number("X-Refers-To-Page")


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty where the records are too few to build one from."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def frames(records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> Iterator[bytes]:
    """The dictionary frame, then a frame for each record."""
    import zstandard

    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    if not held:
        return
    d = build_dictionary(held)
    if d:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(d)) + d
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=True)
    for r in held:
        yield c.compress(r)
    for r in records:
        yield c.compress(r)


def records_of(archive: bytes) -> Iterator[bytes]:
    import zstandard

    view, at, d = memoryview(archive), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        d = zstandard.ZstdCompressionDict(bytes(view[8:at]))
    z = zstandard.ZstdDecompressor(dict_data=d)
    while at < len(view):
        if struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        one = z.decompressobj()
        # a frame's length is not written in it: feed slices until it ends
        out, step = [], 1 << 16
        while True:
            out.append(one.decompress(view[at:at + step]))
            at += step
            if one.eof:
                at = min(at, len(view)) - len(one.unused_data)
                break
            if at >= len(view):
                raise ValueError("archive ends inside a record")
        yield b"".join(out)


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> str:
    """One archive per task; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    yield record(*row)

        for f in frames(records()):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], ["value"])

    out = marked(pages, min_bytes).mapInArrow(run, "value binary")
    # a cast keeps the bytes as they are, and the text writer writes them so
    (out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii"))
     .option("compression", "none").mode("errorifexists").text(path))
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder. An archive, the output of one task, is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for archive in b.column(0):
                rows, size = [], 0
                for raw in records_of(archive.as_buffer()):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ_SCHEMA)
