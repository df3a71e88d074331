"""Importance resampling of documents towards a target set, by hashed word n-grams.

A feature is a run of consecutive words joined by one space; its bucket is the CRC-32 of its bytes modulo the number
of buckets. A text is scanned once: separators count as one space each, and the CRC of all up to the end of every word
is stored. CRC-32 is linear over GF(2), so the CRC of any run follows from two of these prefixes: shift the earlier one
over the bytes of the run and cancel it from the later one. No n-gram is ever cut out or hashed again.

Buckets are counted over all documents and over all target texts; a bucket's gain is the logarithm of the smoothed
ratio of both shares. A document's weight is the mean gain of its features. Weight plus Gumbel noise, drawn from a hash
of the id, ranks the documents: the first k are a sample without replacement in proportion to exp(weight).

Input: doc_id, text (null: no words); other columns, whatever their names, are not looked at. A null doc_id draws like
an empty one and sorts last among equal scores. Repeated rows are rows of their own; which of two rows with equal score
and doc_id ranks first is left open. No documents give no rows; no target texts give the plain smoothed gains.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import cut_lineage
from .common import hold, id_and_text, over_batches

BUCKETS = 10_000
ORDERS = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
# Bytes of text whose words are lists at a time
BLOCK = 1 << 20

SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _one_zero_byte() -> np.ndarray:
    """A register's change by one zero byte, for each value of each of its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (step & np.uint32(1)))
    value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return step[value & np.uint32(255)] ^ (value >> np.uint32(8))


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)]
            ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)])


# SHIFTS[k] moves a register over 2^k bytes
SHIFTS = [_one_zero_byte()]
while len(SHIFTS) < 40:
    SHIFTS.append(_apply(SHIFTS[-1], SHIFTS[-1]))


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved over its number of bytes."""
    out = crc.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        some = np.flatnonzero(n_bytes >> k & 1)
        out[some] = _apply(SHIFTS[k], out[some])
    return out


def over_space(crc: np.ndarray) -> np.ndarray:
    """Each running CRC after one more space."""
    inner = ~crc
    return ~(SHIFTS[0][0][(inner ^ np.uint32(32)) & np.uint32(255)] ^ (inner >> np.uint32(8)))


class Prefixes:
    """Running CRCs of the separator-normalised texts of a batch: after each word, with the words' lengths."""

    def __init__(self) -> None:
        self.ends, self.lengths, self.words = array("I"), array("q"), array("q")

    def add(self, text: bytes | None) -> None:
        text, at, crc, before = (text or b"").translate(SPACED), 0, 0, len(self.ends)
        while at < len(text):
            end = text.find(b" ", at + BLOCK) if len(text) - at > BLOCK else -1
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            if words:
                # the first word of a text has no space before it
                if len(self.ends) == before:
                    crc = zlib.crc32(words[0])
                    self.ends.append(crc)
                    rest = words[1:]
                else:
                    rest = words
                running = accumulate(map(b" ".__add__, rest), lambda c, w: zlib.crc32(w, c), initial=crc)
                self.ends.extend(islice(running, 1, None))
                crc = self.ends[-1]
                self.lengths.extend(map(len, words))
            at = end
        self.words.append(len(self.ends) - before)

    def features(self, orders: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the CRC of every run of so many words, and the number of runs of each text."""
        ends, words = np.frombuffer(self.ends, np.uint32), np.array(self.words, np.int64)
        to = np.cumsum(np.array(self.lengths, np.int64) + 1) - 1
        begins = to - np.array(self.lengths, np.int64)
        of = np.repeat(np.arange(len(words)), words)
        first = np.zeros(len(ends), bool)
        first[(np.cumsum(words) - words)[words > 0]] = True
        starts = over_space(np.concatenate((np.zeros(1, np.uint32), ends[:-1]))) if len(ends) else ends
        starts[first] = 0
        for n in range(orders[0], orders[1] + 1):
            i = np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else of[:0]
            j = i + n - 1
            yield ends[j] ^ shift(starts[i], to[j] - begins[i]), np.maximum(words - n + 1, 0)


def _slices(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Prefixes]]:
    """Rows from, to and their prefixes, a few megabytes of text at a time."""
    texts = b.column(column).cast(pa.binary())
    at, held, got = 0, 0, Prefixes()
    for i, t in enumerate(texts):
        t = t.as_py()
        got.add(t)
        held += len(t or b"")
        if held >= 4 * BLOCK:
            yield at, i + 1, got
            at, held, got = i + 1, 0, Prefixes()
    if at < b.num_rows:
        yield at, b.num_rows, got


def bucket_counts(texts: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over the column text. A task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("importance")
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, got in _slices(b, 0):
                for crc, _ in got.features(orders):
                    n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    counted = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket. As many rows as buckets reach the driver, whatever the size of the texts."""
    of = {}
    for name, counts in (("source", source), ("target", target)):
        of[name] = [0] * buckets
        for r in counts.collect():
            of[name][r.bucket] = r.n
    total, aim = float(sum(of["source"])), float(sum(of["target"]))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + buckets) / ((s + 1.0) * (aim + buckets))))
                     for s, t in zip(of["source"], of["target"])], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """1000 times a Gumbel number drawn from the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, orders: tuple[int, int] = ORDERS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        hold("importance")
        value = shared.value

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for at, to, got in _slices(b, 1):
                words[at:to] = got.words
                for crc, runs in got.features(orders):
                    sums = np.concatenate(([0], np.cumsum(value[crc % np.uint32(len(value))])))
                    ends = np.cumsum(runs)
                    n[at:to] += runs
                    total[at:to] += sums[ends] - sums[ends - runs]
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(x, seed) for x in b.column(0).to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, n, weight, score))],
                                              ["doc_id", "n_words", "n_features", "weight", "score"])

        return apply

    return over_batches(id_and_text(docs), make, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank: 1, 2, 3, ... for the drawn percent of the documents with
    enough words, null for all others. Ranks come from a range sort of narrow rows; no task sees them all."""
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets), buckets)
    scored = cut_lineage(weights(docs, gain, orders, seed).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.filter(enough).count() // 100
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = global_position(scored, order, "at")
    rank = F.when(enough & (F.col("at") < drawn), F.col("at") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB's SQL, four bits at a time."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    nibble = f"(instr('0123456789ABCDEF', substr(hex(encode({text})), xor(k, 1) + 1, 1)) - 1)::BIGINT"
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, 2 * octet_length(encode({text}))), "
            f"lambda k: {nibble}), lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1])))")


def resample_sql() -> str:
    """The default parameters over documents and benchmark."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS MATERIALIZED (SELECT {words} AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM d), bw AS MATERIALIZED (SELECT unnest(ws) AS w FROM b),
known AS MATERIALIZED (SELECT w, {crc32_sql('w')} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN known USING (w) GROUP BY bucket),
gain AS MATERIALIZED (SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT AS g
    FROM (SELECT DISTINCT bucket FROM known) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
    FROM dw JOIN known USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) AS enough FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
    CASE WHEN n_features >= {MIN_WORDS} AND place <= enough * {PERCENT} // 100 THEN place END AS rank FROM ranked"""
