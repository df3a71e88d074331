"""Groups named by an outside model in batches of twenty, merged over all batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.paths import _c
from ..functions.text import label_key, trim_unicode
from .ranking import global_position


def batches(items: DataFrame, order: list[Column], size: int = K.LABEL_BATCH) -> DataFrame:
    """Adds batch_id, and the ordinal among the batch's items that could be prepared (`valid`)."""
    b = global_position(items, order).withColumn("batch_id", F.floor(F.col("position") / size).cast("long"))
    w = W.partitionBy("batch_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(F.col("valid").cast("int")).over(w)  # a batch has at most `size` rows
    return b.withColumn("valid_no", F.when(F.col("valid"), n - 1))


def reply_json(reply) -> Column:
    """The JSON object inside a reply, fences and chatter removed."""
    t = trim_unicode(reply)
    t = F.regexp_replace(t, r"(?iU)^```(?:json)?\s*", "")
    t = trim_unicode(F.regexp_replace(t, r"```$", ""))
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))


def reply_groups(reply) -> Column:
    """Array of groups as variants; null where the reply holds no readable list."""
    v = F.try_parse_json(reply_json(reply))
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.groups", "variant")).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(v, "$.groups", "array<variant>"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(batch_id, g_pos, name, i_pos, item_no) out of (batch_id, reply). Names that are no strings and
    indices that are no whole numbers are left out."""
    g = replies.select("batch_id", F.posexplode(reply_groups("reply")).alias("g_pos", "g"))
    name = F.try_variant_get("g", "$.name", "variant")
    idx = F.try_variant_get("g", "$.indices", "variant")
    g = g.select(
        "batch_id", "g_pos",
        F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get("g", "$.name", "string")).alias("name"),
        F.when(F.schema_of_variant(idx).startswith("ARRAY"), F.try_variant_get("g", "$.indices", "array<variant>")).alias("ix"),
    ).filter("name IS NOT NULL")
    i = g.select("batch_id", "g_pos", "name", F.posexplode("ix").alias("i_pos", "i"))
    whole = F.schema_of_variant("i") == "BIGINT"
    return i.select("batch_id", "g_pos", "name", "i_pos",
                    F.when(whole, F.try_variant_get("i", "$", "long")).alias("item_no")).filter("item_no IS NOT NULL")


def reply_audit(replies: DataFrame) -> DataFrame:
    """Per reply: whether its list could be read, and how many groups it has."""
    g = reply_groups("reply")
    return replies.select("batch_id", g.isNotNull().alias("readable"), F.coalesce(F.size(g), F.lit(0)).alias("n_groups"))


def merge_labelled(replies: DataFrame, batched: DataFrame) -> DataFrame:
    """Member form (label_key, batch_id, g_pos, i_pos, asset_id) with the name first used. An item may
    sit in several groups; indices beyond the batch's prepared items drop out."""
    m = parse_replies(replies).withColumn("label_key", label_key("name")).filter("label_key <> ''")
    items = batched.filter("valid").select("batch_id", F.col("valid_no").cast("long").alias("item_no"), "asset_id")
    m = m.join(items, ["batch_id", "item_no"])
    names = m.groupBy("label_key").agg(
        F.min_by(trim_unicode("name"), F.struct("batch_id", "g_pos")).alias("suggested_name"),
        F.min(F.struct("batch_id", "g_pos")).alias("first_at"))
    return m.join(names, "label_key").select(
        "label_key", "suggested_name", "first_at", "batch_id", "g_pos", "i_pos", "asset_id")


def merged_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("label_key", "suggested_name", "first_at").agg(F.count(F.lit(1)).alias("n_items"))


def merged_order() -> list[Column]:
    return [F.col("n_items").desc(), F.col("first_at").asc()]


def unplaced(batched: DataFrame, members: DataFrame) -> DataFrame:
    """Items no group took up: not prepared, left out by the model, or in an unreadable reply."""
    return batched.join(members.select("asset_id").distinct(), "asset_id", "left_anti").select(
        "asset_id", "batch_id", F.when(_c("valid"), "not_in_a_group").otherwise("not_prepared").alias("cause"))
