"""What a planned deletion loses, and what has to be confirmed before it.

A check has one row per file: its verdict (``places.verdict``), its class
(``places.purge_class``), whether its item could be read, whether a copy is named
for it, and when it was confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import places

VERDICTS = ("safe", "copy_offline", "unique", "unreadable", "opaque_archive", "no_content")
CLASSES = ("likely_junk", "uncertain", "possibly_valuable")


def gated(verdict: Column, copy_path: Column, item_readable: Column) -> Column:
    """Does a file need a confirmation (F20)?  Files of an item that could not be read are refused and need none."""
    open_ = verdict.isin("unique", "copy_offline", "unreadable") | ((verdict == "opaque_archive") & copy_path.isNull())
    return F.coalesce(open_, F.lit(False)) & ~item_readable.eqNullSafe(F.lit(False))


def confirmed(confirmed_at: Column, verdict: Column, cls: Column, junk_confirmed_at: Column) -> Column:
    """Has a file its confirmation (F20): its own, or, if it is the only copy of likely junk, the group's?"""
    group = (verdict == "unique") & cls.eqNullSafe(F.lit("likely_junk")) & junk_confirmed_at.isNotNull()
    return confirmed_at.isNotNull() | F.coalesce(group, F.lit(False))


def confirmed_one_by_one(verdict: Column, cls: Column, copy_path: Column) -> Column:
    """Is a file confirmed by itself rather than with its group?"""
    alone = (verdict == "unique") & ~cls.eqNullSafe(F.lit("likely_junk"))
    return F.coalesce(verdict.isin("copy_offline", "unreadable") | ((verdict == "opaque_archive") & copy_path.isNull()) | alone, F.lit(False))


def unconfirmed(check: DataFrame) -> DataFrame:
    """Files that keep a deletion from running (X15): they need a confirmation and have none."""
    return check.where(F.col("gated") & ~F.col("confirmed"))


def counts(check: DataFrame) -> DataFrame:
    """Files and bytes of a check by ``verdict``, ``class``, ``gated`` and ``confirmed`` (A23); what has no content of its own has no bytes."""
    size = F.when((F.col("verdict") == "no_content") & F.col("is_file"), 0).otherwise(F.col("size"))
    return check.groupBy("verdict", F.coalesce("class", F.lit("")).alias("class"), "gated", "confirmed").agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


def spare_copies(items: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """Adds ``other_online`` and ``other_offline``: has the content ``key`` a copy besides the file itself (``own``, its physical key)?

    ``copy`` holds the copies that a plan leaves.  Figures per content and per
    physical copy answer it; no list of copies travels.
    """
    per_copy = copy.groupBy(F.col("digest").alias(key), F.col("pkey").alias("own")).agg(F.max(F.col("online").cast("int")).alias("own_on"), F.max((~F.col("online")).cast("int")).alias("own_off"))
    per = per_copy.groupBy(key).agg(F.sum("own_on").alias("all_on"), F.sum("own_off").alias("all_off"))
    at = items.join(per, key, "left").join(per_copy, [key, "own"], "left")
    rest = lambda c: F.coalesce(F.col(f"all_{c}"), F.lit(0)) > F.coalesce(F.col(f"own_{c}"), F.lit(0))
    return at.withColumns({"other_online": rest("on"), "other_offline": rest("off")}).drop("all_on", "all_off", "own_on", "own_off")


def judged(items: DataFrame, copy: DataFrame, key: str, listing: Column) -> DataFrame:
    """``items`` with their ``verdict`` (X12); what is missing has none and is left out."""
    at = spare_copies(items, copy, key)
    return at.withColumn("verdict", places.verdict(F.col("item_readable"), F.col("other_online"), F.col("other_offline"), listing)).where("verdict is not null")
