"""Hashes of contents and images, and the distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .paths import _c, once


def quick_hash(content, size) -> Column:
    """SHA-256 over the first and last 16 KiB (or all of a small file) and the size."""
    content, size = _c(content), _c(size)
    k = K.HEAD_TAIL_BYTES
    part = F.when(size <= 2 * k, content).otherwise(
        F.concat(F.substring(content, 1, k), F.substring(content, -k, k))
    )
    return F.sha2(F.concat(part, F.concat(F.lit("|"), size.cast("string")).cast("binary")), 256)


def content_digest(content) -> Column:
    return F.sha2(_c(content), 256)


def average_hash(gray) -> Column:
    """64 bits of an 8x8 grey image: set where a value is above the mean, first value highest."""
    g = _c(gray)
    mean = F.aggregate(g, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(g)


    def bits(m: Column) -> Column:
        return F.aggregate(g, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(
            F.when(x.cast("double") > m, 1).otherwise(0).cast("long")))

    return F.when(F.size(g) == 64, once(mean, bits))


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def hash_label(a_hash, text_hash) -> Column:
    """How the hash of a near group is shown."""
    a, t = _c(a_hash), _c(text_hash)
    return (
        F.when(a.isNotNull(), F.concat(F.lit("~"), F.lower(F.lpad(F.hex(a), 16, "0"))))
        .when(t.isNotNull(), F.concat(F.lit("~txt:"), F.substring(t, 1, 12)))
        .otherwise("~?")
    )


def cache_fingerprint(path, mtime, size) -> Column:
    """Key of a file version: path, modification time in microseconds and size."""
    stamp = F.unix_micros(_c(mtime)).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", _c(path), stamp, _c(size).cast("string")), 256), 1, 24)


def frame_fingerprint(path, mtime, size, offset, pixels) -> Column:
    """Key of one video frame; a frame at one second, 256 pixels wide, shares the file's own key."""
    offset, pixels = _c(offset).cast("double"), _c(pixels)
    stamp = F.unix_micros(_c(mtime)).cast("string")
    plain = (F.abs(offset - 1.0) < 1e-9) & (pixels == 256)
    extra = F.when(~plain, F.concat(F.format_string("|t%.2f", offset), F.format_string("|s%d", pixels))).otherwise("")
    key = F.concat(F.concat_ws("|", _c(path), stamp, _c(size).cast("string")), extra)
    return F.substring(F.sha2(key, 256), 1, 24)


def match_percent(avg_distance) -> Column:
    """Likeness of near images out of the mean distance to the group's largest item."""
    return F.bround((F.lit(64.0) - _c(avg_distance)) / 64.0 * 100.0, 0).cast("int")
