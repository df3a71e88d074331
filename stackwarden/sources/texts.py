"""Text of an asset out of its ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(parts: Column, max_chars: int | None) -> Column:
    text = F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def assemble_text(parts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(asset_id, text) from pages or paragraphs (asset_id, part_no, text), joined by line breaks. Whole
    texts by default; max_chars cuts the result. A missing part counts as empty."""
    part = F.struct("part_no", F.coalesce("text", F.lit("")).alias("text"))
    return parts.groupBy("asset_id").agg(_joined(F.collect_list(part), max_chars).alias("text"))


def assemble_sheets(cells: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(asset_id, text) from cells (asset_id, sheet_no, sheet, row_no, col_no, value): a header line per
    sheet, then the non-blank cells of each row joined by ' | '."""
    filled = cells.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    rows = filled.groupBy("asset_id", "sheet_no", "row_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "value"))), lambda c: c["value"]), " | ").alias("text"))
    heads = cells.groupBy("asset_id", "sheet_no").agg(F.first("sheet").alias("sheet")).select(
        "asset_id", "sheet_no", F.lit(-1).cast("long").alias("row_no"), F.concat(F.lit("[Feuille: "), "sheet", F.lit("]")).alias("text"))
    lines = rows.select("asset_id", "sheet_no", F.col("row_no").cast("long").alias("row_no"), "text").unionByName(heads)
    return lines.groupBy("asset_id").agg(
        _joined(F.collect_list(F.struct("sheet_no", "row_no", "text")), max_chars).alias("text"))
