"""Display values: sizes, dates, dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c, file_name, suffix


def _fixed(v: Column, places: int) -> Column:
    """A double of 1 or more with so many places, by its exact binary value, halves to even, as C's printf has it. Java's
    formats and Spark's rounding go by the shortest decimal that reads back the same, which differs for large sizes."""
    one = 1 << 52  # a double of 1 or more has 52 binary places at most
    part = v % F.lit(1.0)
    n = (part * F.lit(float(one))).cast("long") * 10**places
    q, r = F.shiftright(n, 52), n.bitwiseAND(F.lit(one - 1))
    q = q + ((r > one // 2) | ((r == one // 2) & (q % 2 == 1))).cast("long")
    whole = v - part + (q >= 10**places).cast("double")
    digits = F.when(whole < 2.0**63, whole.cast("long").cast("string")).otherwise(F.format_string("%.0f", whole))
    return F.concat(digits, F.lit("."), F.lpad((q % 10**places).cast("string"), places, "0"))


def human_size(size) -> Column:
    """Size with a unit. Any number will do, also one beyond what a long holds; null has no label."""
    d = _c(size).cast("double")
    return (
        F.when(d < 1024, F.concat(d.cast("long").cast("string"), F.lit(" o")))
        .when(d < 1024**2, F.concat(_fixed(d / 1024, 1), F.lit(" Ko")))
        .when(d < 1024**3, F.concat(_fixed(d / 1024**2, 1), F.lit(" Mo")))
        .otherwise(F.concat(_fixed(d / 1024**3, 2), F.lit(" Go")))
    )


def detail_columns(path, kind, size, mtime, width, height) -> list[Column]:
    """The columns of an asset's detail view."""
    kind, w, h = _c(kind), _c(width), _c(height)
    dotted = F.when(suffix(path) != "", F.concat(F.lit("."), F.upper(suffix(path)))).otherwise("")
    return [
        file_name(path).alias("name"),
        F.when(kind == "other", dotted).otherwise(F.upper(kind)).alias("type"),
        human_size(size).alias("size_label"),
        F.coalesce(F.date_format(_c(mtime), "yyyy-MM-dd HH:mm"), F.lit("-")).alias("modified"),
        F.when((kind == "image") & w.isNotNull() & h.isNotNull(),
               F.concat_ws(" x ", w.cast("string"), h.cast("string"))).otherwise("-").alias("resolution"),
    ]


def exif_year(original, modified) -> Column:
    """Year of the original date, else of the change date, if it is plausible."""

    def year(x: Column) -> Column:
        y = F.substring(x, 1, 4).try_cast("int")
        return F.when((F.length(x) >= 4) & y.between(1990, 2100), y)

    return F.coalesce(year(_c(original)), year(_c(modified)))
