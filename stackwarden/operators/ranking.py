"""Places and positions that hold when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

# A group up to this size may be sorted inside one task.
GROUP_ROWS_PER_TASK = 1_000_000
_LOW33 = (1 << 33) - 1


def biggest_group(df: DataFrame, groups: Sequence[str]) -> int:
    return df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0


def sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sorted rows with the number of their slice and their index in it. A range sort splits a
    large group over many slices, since the order ends in a unique key."""
    # monotonically_increasing_id = slice number << 33 | index in the slice
    s = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    return s.select(*df.columns, F.shiftright("_m", 33).alias("_slice"),
                    F.col("_m").bitwiseAND(F.lit(_LOW33)).alias("_idx"))


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position of every row in a total order, without a one-task sort."""
    s = sorted_slices(df, order)
    counts = s.groupBy("_slice").count()  # one row per slice
    before = F.sum("count").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_slice", F.coalesce(before, F.lit(0)).alias("_off"))
    return s.join(offsets, "_slice").select(*df.columns, (F.col("_off") + F.col("_idx")).alias(name))


def place_in_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    name: str = "place",
    rows_per_task: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """1-based place of each row in its group. The order must end in a unique key.

    Groups known to be small take a plain window. As soon as one is larger, the rows are range-sorted
    instead and the places come from slice indexes and per-slice counts.
    """
    groups = list(groups)
    if biggest_group(df, groups) <= rows_per_task:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long"))
    s = sorted_slices(df, [F.col(g) for g in groups] + list(order))
    pieces = s.groupBy(*groups, "_slice").agg(F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_n"))
    # a group has at most one piece per slice
    w = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return s.join(pieces, groups + ["_slice"]).select(
        *df.columns, (F.col("_before") + F.col("_idx") - F.col("_start") + 1).alias(name)
    )


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. The filter right above row_number lets Spark cut every group to
    n rows per input partition before the shuffle, so a large group is never gathered."""
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def page_of(df: DataFrame, order: Sequence[Column], per_page: int) -> DataFrame:
    """Result order with a 0-based position and a 1-based page number."""
    p = global_position(df, order, "position")
    return p.withColumn("page_no", (F.floor(F.col("position") / per_page) + 1).cast("long"))


def one_page(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """A single page near the top of the result, read without numbering all rows."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
