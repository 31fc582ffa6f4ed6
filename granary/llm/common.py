"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the scale-factor folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the session's shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset and all runs on one machine (tests) is a temporary one chosen.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that what a task holds in Python stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def text_name(text: str | Column) -> Column:
    """128 bits that name a text (null as empty); with the id they name a row's content."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text ``gone`` names, and one of the rows that repeat an id and a text of ``repeated``.

    Both tables have ``row_id`` and ``name`` (``text_name``), once each; another
    text of a dropped id stays.  A null id is in neither.  ``repeated`` is
    read back to tell whether there are any; which of the repeated rows stays is
    open where their other columns differ.
    """

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, (rows[id_col] == keys["row_id"]) & (text_name(rows[text_col]) == keys["name"]), how)

    left = matching(docs, gone, "left_anti")
    repeated = checkpoint(repeated)
    if repeated.isEmpty():
        return left
    name = fresh(docs, "name")
    again = matching(left, repeated, "left_semi").withColumn(name, text_name(text_col)).dropDuplicates([id_col, name]).drop(name)
    return matching(left, repeated, "left_anti").unionByName(again)


def prefix_sums(df: DataFrame, order: list[str], *values: str) -> DataFrame:
    """Exclusive running sums of ``values`` and the global row number over the whole table.

    Rows are dealt into key ranges, each range is summed by itself, and the
    sums of the ranges (one row per partition, so a bounded table) become the
    offsets.  Adds ``<value>_before`` for each value and ``row_index``; the table
    is checkpointed once so that the ranges stay the same for both readings.
    Equal rows take consecutive places in any order.
    """
    n = partitions(df.sparkSession)
    ranged = checkpoint(df.repartitionByRange(n, *order).withColumn("range_id", F.spark_partition_id()))
    return running_sums(ranged, order, *values).drop("range_id")


def running_sums(ranged: DataFrame, order: list[str], *values: str) -> DataFrame:
    """``prefix_sums`` of a checkpointed table whose ranges ``range_id`` follow ``order`` already."""
    totals = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("rows_here"), *(F.sum(v).alias(f"{v}_here") for v in values))
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["rows", *values]
    offsets = totals.select("range_id", *(F.coalesce(F.sum(f"{v}_here").over(earlier), F.lit(0)).alias(f"{v}_offset") for v in sums))
    inside = Window.partitionBy("range_id").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumns({f"{v}_inside": F.coalesce(F.sum(v).over(so_far), F.lit(0)) for v in values} | {"rows_inside": F.row_number().over(inside) - 1})
        .join(F.broadcast(offsets), "range_id")  # at most one row per partition
        .withColumns({f"{v}_before": F.col(f"{v}_inside") + F.col(f"{v}_offset") for v in values} | {"row_index": F.col("rows_inside") + F.col("rows_offset")})
        .drop(*(f"{v}_{x}" for v in sums for x in ("inside", "offset")))
    )
