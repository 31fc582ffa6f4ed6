"""Exact deduplication by 128-bit content hash with byte comparison.

Texts are grouped by their MD5 (128 bits) and, inside a hash, by the bytes of
the text itself, so two texts that share a hash by accident stay apart.  The
grouping pre-aggregates before the shuffle: a text that fills a third of the
table travels once per map task.

Null text counts as the empty text.  Rows that repeat an id and a text are the
same document: one of them stays where they stay.  Rows with one id and
different texts are different documents.  A null id never survives over a
non-null one, and filters never drop its row.  Other columns are untouched and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, without


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).withColumn("hash128", F.unhex(F.md5("body")))


def repeated_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per text that occurs more than once.

    Returns ``hash128``, ``sha256`` (binary; with the hash it names the text),
    ``keep_id`` (smallest or largest id) and ``group_size``.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    return (
        _hashed(docs, id_col, text_col)
        .groupBy("hash128", "body")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("hash128", F.unhex(F.sha2("body", 256)).alias("sha256"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Every row with its group: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Only hashes and ids are joined.  The table of repeated texts is
    checkpointed, so both sides of the join are plain exchanges and adaptive
    execution can split a group that holds much of the table.
    """
    repeated = checkpoint(repeated_classes(docs, id_col, text_col, keep))
    rows = _hashed(docs, id_col, text_col).select("id", "hash128", F.unhex(F.sha2("body", 256)).alias("sha256"))
    return _judged(rows, repeated).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def _judged(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    return rows.join(repeated, ["hash128", "sha256"], "left").select(
        "id",
        "hash128",
        "sha256",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each text, the one with the ``keep`` id, with its columns unchanged; null ids stay."""
    repeated = checkpoint(repeated_classes(docs, id_col, text_col, keep))
    rows = _hashed(docs, id_col, text_col).select("id", "hash128", F.unhex(F.sha2("body", 256)).alias("sha256"))
    judged = _judged(rows, repeated).where("id is not null and group_size > 1")
    per_row = checkpoint(judged.groupBy(F.col("id").alias("row_id"), F.col("hash128").alias("name"), "kept").agg(F.count(F.lit(1)).alias("n")))
    gone = per_row.where("not kept").select("row_id", "name")
    return without(docs, gone, per_row.where("kept and n > 1").select("row_id", "name"), id_col, text_col)
