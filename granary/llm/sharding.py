"""Contiguous, byte-balanced shards from global prefix sums.

Documents are ordered by the smallest id of their text, then by id, so equal
texts stand together.  Each key range is summed by itself, the sums of the
ranges become offsets, and a unit goes to the shard in whose equal share of the
total its middle byte falls.  A unit is a row, or all rows of one text where they
take no more than ``TOGETHER`` of a shard, however many they are.  Only what the
balance of bytes forces is cut: a larger group, wherever the shares end.  So
shards are contiguous in that order and their sizes differ by little more than
the largest unit.  Places come from the running sums of all rows, so no group of
copies has to fit one task.  DataFrame functions only.

Size is the UTF-8 length of the text (null: 0) plus a fixed cost per record,
so empty and null texts have a place too; a null text counts as the empty one.
Rows that tie on every ordering column are interchangeable.  Null ids come
first.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, prefix_sums

#: Share of a shard's size up to which the copies of one text stay in one shard.
TOGETHER = 0.02


def assign_shards(docs: DataFrame, shards: int = 24, record_cost: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``size``, ``text_crc32``, ``shard`` (0 to shards-1), ``slot`` (gapless from 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + record_cost).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_key"),
    )
    whole = thin.agg(F.sum("size").alias("total"))  # one row
    copies = thin.groupBy("text_key").agg(F.min("id").alias("lead"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    repeated = copies.where("group_rows > 1").join(F.broadcast(whole)).select(
        "text_key", "lead", F.when(F.col("group_size") * shards <= TOGETHER * F.col("total"), F.col("group_size")).alias("group_size")
    )
    rows = thin.join(repeated, "text_key", "left").withColumn("lead", F.coalesce("lead", "id"))
    placed = checkpoint(prefix_sums(rows, ["lead", "text_key", "id"], "size"))
    starts = placed.where("group_size is not null").groupBy("text_key").agg(F.min("size_before").alias("start"))
    middle = F.coalesce(2 * F.col("start") + F.col("group_size"), 2 * F.col("size_before") + F.col("size"))
    cut = placed.join(starts, "text_key", "left").join(F.broadcast(whole)).withColumn("middle", middle)
    cut = cut.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(middle * {shards}) div (2 * total)")).cast("int"))
    first = cut.groupBy("shard").agg(F.min("row_index").alias("first_row"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_row")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of ``docs`` below ``path``, one folder per shard, in slot order.

    Rows are dealt by (shard, slot range), so no shard has to fit one task.
    """
    places = assigned.select(F.col(id_col).alias("place_id"), "shard", "slot")
    (
        docs.join(places, docs[id_col] == places["place_id"])
        .drop("place_id")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
