"""Long runs: cutting their lineage, and numbering rows of groups of any size."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` read back from files in the folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and all runs on one machine (tests) is a temporary
    folder chosen.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return df.checkpoint()


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to some tasks per core, for work on each row that takes longer than to send it."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


#: Rows of a table that meet in one task of a join which ``dealt`` sizes.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table dealt by a join's ``key`` into tasks of TASK_ROWS, where these are more than the session's shuffle partitions.

    The session's number is fixed, so that the rows of a task, and the memory to
    sort and add them up, grow with the table.  Tables are counted by their footers.
    They are not broadcast either: few columns of a well packed file look small.
    """
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts, key).hint("merge") if parts > _partitions(rows) else rows


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Buckets of keys that ``sizes`` counts.
BUCKETS = 1 << 16


def sizes(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of each bucket of ``key``: BUCKETS rows at most, so they are broadcast where they are joined."""
    return checkpoint(rows.groupBy(_bucket(key).alias("granary_bucket")).agg(F.count(F.lit(1)).alias("granary_rows")))


def _bucket(key: Sequence[str]):
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def reduced(rows: DataFrame, key: list[str], apart: str, reduce: Callable[[DataFrame, list[str]], DataFrame], counts: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """``reduce(rows, key)`` in tasks of about TASK_ROWS rows, where these are more than the session's shuffle partitions.

    ``reduce`` brings each group to few rows and may be run twice: a group in a
    bucket of more than an eighth of TASK_ROWS rows is first cut by the hash of
    ``apart`` and the cuts reduced, so no group has to be read by one task.  ``counts`` are the
    ``sizes`` of the rows by ``key`` and ``bound`` is a number they do not exceed,
    where these are known.
    """
    enough = TASK_ROWS * _partitions(rows)
    if bound is not None and bound <= enough:
        return reduce(rows, key)
    counts = sizes(rows, key) if counts is None else counts
    total, largest = counts.agg(F.sum("granary_rows"), F.max("granary_rows")).first()
    if (total or 0) <= enough:
        return reduce(rows, key)
    parts, piece = -(-total // TASK_ROWS), max(1, TASK_ROWS // 8)
    if largest > piece:
        cuts = counts.where(F.col("granary_rows") > piece).select("granary_bucket", F.ceil(F.col("granary_rows") / piece).alias("granary_cuts"))
        cut = F.coalesce(F.pmod(F.xxhash64(apart), F.col("granary_cuts")), F.lit(0))
        met = rows.withColumn("granary_bucket", _bucket(key)).join(F.broadcast(cuts), "granary_bucket", "left").withColumn("granary_cut", cut)
        cut_key = [*key, "granary_cut"]
        rows = reduce(met.drop("granary_bucket", "granary_cuts").repartition(parts, *cut_key), cut_key).drop("granary_cut")
    return reduce(rows.repartition(parts, *key), key)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: each row's place (from 1) in its group ``by`` in ``order``, without a group having to fit one task.

    Rows are dealt into ranges of (by, order) and numbered inside each; a group
    that runs over several ranges goes on counting from the ranges before.  Such
    groups are fewer than the ranges, so their offsets are broadcast.
    """
    inside, at, before = f"{name}_inside", f"{name}_range", f"{name}_before"
    ranged = checkpoint(rows.repartitionByRange(*by, *order).withColumn(at, F.spark_partition_id()))
    counts = ranged.groupBy(at, *by).agg(F.count(F.lit(1)).alias(inside))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(at, *by, F.sum(inside).over(earlier).alias(before)).where(F.col(before) > 0)
    offsets = offsets.select(*(F.col(c).alias(f"{name}_{k}") for k, c in enumerate([at, *by])), before)
    same = [F.col(c).eqNullSafe(F.col(f"{name}_{k}")) for k, c in enumerate([at, *by])]
    placed = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(at, *by).orderBy(*order)))
    joined = placed.join(F.broadcast(offsets), functools.reduce(lambda x, y: x & y, same), "left")
    return joined.withColumn(name, F.col(inside) + F.coalesce(before, F.lit(0))).drop(inside, before, *(f"{name}_{k}" for k in range(len(by) + 1)), at)
