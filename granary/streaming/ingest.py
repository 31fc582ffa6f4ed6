"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; a temporary one where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="granary-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Hash buckets of a stored table; a batch rewrites those that it touches.
BUCKETS = 16


def _versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket that is committed, of batches before ``before``: BUCKETS rows at most."""
    try:
        pointers = spark.read.schema("bucket int, version long").parquet(f"{root}/pointers/*")
    except AnalysisException:  # nothing is written yet
        return {}
    known = pointers if before is None else pointers.where(F.col("version") < before)
    return {r[0]: r[1] for r in known.groupBy("bucket").agg(F.max("version")).collect()}


def _read(spark: SparkSession, root: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    paths = [f"{root}/data/version={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table as the last committed batch left it."""
    return _read(spark, root, schema, _versions(spark, root))


def merge_batch(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``table`` after the changes of a batch: deletes first, then inserts, then updates (T4).

    ``batch`` has ``op`` (delete, insert, update), ``seq`` and the table's columns.
    Of several inserts or updates of a key the last by ``seq`` counts; an update
    changes the columns that it gives (not null) of a row that is there by then.
    """
    values = [c for c in table.columns if c != key]
    row = F.struct(*values)
    of = lambda op: F.max_by(F.when(F.col("op") == op, row), F.when(F.col("op") == op, F.col("seq")))
    per = batch.groupBy(key).agg(F.bool_or(F.col("op") == "delete").alias("gone"), of("insert").alias("new"), of("update").alias("change"))
    old = table.select(key, row.alias("old"))
    joined = old.join(per, key, "full_outer")
    kept = F.when(~F.coalesce("gone", F.lit(False)), F.col("old"))
    based = joined.withColumn("base", F.coalesce("new", kept)).where("base is not null")
    return based.select(key, *(F.coalesce(F.col("change")[v], F.col("base")[v]).alias(v) for v in values)).select(*table.columns)


def commit(root: str, batch: DataFrame, number: int, schema: StructType, key: str) -> None:
    """Write the next version of the buckets that a batch touches, then the pointers to them.

    The pointers, a small table of their own, are what makes a version current,
    and they are written last.  A batch that is replayed starts from the same
    versions before it and overwrites its own, so it ends the same.
    """
    spark = batch.sparkSession
    before = _versions(spark, root, number)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # BUCKETS rows at most
    if not touched:
        return
    old = _read(spark, root, schema, {b: v for b, v in before.items() if b in touched})
    merged = merge_batch(old, batch, key).withColumn("bucket", bucket)
    write_version(merged, root, number)
    # a bucket that lost its last row has no folder: an empty one stands for it
    have = {r[0] for r in merged.select("bucket").distinct().collect()}
    for b in sorted(set(touched) - have):
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/data/version={number}/bucket={b}")
    flip(spark, root, number, touched)


def write_version(rows: DataFrame, root: str, number: int) -> None:
    rows.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={number}")


def flip(spark: SparkSession, root: str, number: int, buckets: list[int]) -> None:
    pointers = spark.createDataFrame([(b, number) for b in buckets], "bucket int, version long")
    pointers.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointers/batch={number}")


def ingest(changes: DataFrame, root: str, state: str, schema: StructType, key: str) -> None:
    """Apply a stream of changes to the table below ``root``; ``state`` is the stream's own checkpoint folder."""
    # batch numbers of a stream start at 0; version 0 is what was there before it
    write = lambda batch, number: commit(root, batch, number + 1, schema, key)
    changes.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
