"""Schemas of the tables the operators take. Everything is declared, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType, BinaryType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

_LONG, _INT, _STR, _TIME = LongType(), IntegerType(), StringType(), TimestampType()
_VEC = ArrayType(FloatType())


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


ASSETS = _table(asset_id=_LONG, path=_STR, size=_LONG, mtime=_TIME, kind=_STR)
CONTENTS = _table(asset_id=_LONG, content=BinaryType())
IMAGE_META = _table(asset_id=_LONG, width=_INT, height=_INT, exif_original=_STR, exif_modified=_STR)
GRAY64 = _table(asset_id=_LONG, gray=ArrayType(DoubleType()))
PIXELS = _table(asset_id=_LONG, r=_INT, g=_INT, b=_INT)
TEXT_PARTS = _table(asset_id=_LONG, part_no=_LONG, text=_STR)
CELLS = _table(asset_id=_LONG, sheet_no=_INT, sheet=_STR, row_no=_LONG, col_no=_INT, value=_STR)
VECTORS = _table(asset_id=_LONG, modality=_STR, vec=_VEC)
EXEMPLARS = _table(folder=_STR, modality=_STR, seq=_LONG, vec=_VEC)
MOVE_LOG = _table(move_id=_LONG, ts=_TIME, folder=_STR, asset_id=_LONG)
RULES = _table(pattern=_STR, folder=_STR, updated_at=_TIME, seq=_LONG)
TAG_VECTORS = _table(tag=_STR, tag_ord=_INT, vec=_VEC)
VECTOR_CACHE = _table(fingerprint=_STR, vec=_VEC)
REPLIES = _table(batch_id=_LONG, reply=_STR)
SUGGESTIONS = _table(asset_id=_LONG, path=_STR, kind=_STR, category=_STR, suggested_folder=_STR,
                     confidence=DoubleType(), reason=_STR)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order and types; an error names what is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema])
