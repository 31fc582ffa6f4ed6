"""Ingest of ordered changes: merged by phase, and the same after a kill and a restart."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from granary.operators import fold
from granary.streaming import ingest

TABLE = StructType().add("k", LongType()).add("x", LongType()).add("y", StringType())
CHANGE = "k long, x long, y string, op string, seq long"


def plainly(table, batch):
    out = {k: v for k, v in table.items() if not any(r[0] == k and r[3] == "delete" for r in batch)}
    for op in ("insert", "update"):
        for k, x, y, _, _ in sorted((r for r in batch if r[3] == op), key=lambda r: r[4]):
            if op == "insert":
                out[k] = (x, y)
    for k in out:
        last = max((r for r in batch if r[0] == k and r[3] == "update"), key=lambda r: r[4], default=None)
        if last:
            out[k] = tuple(n if n is not None else o for n, o in zip(last[1:3], out[k], strict=True))
    return out


def batches(seed, n=3):
    rng = random.Random(seed)
    return [[(rng.randrange(12), rng.choice([None, rng.randrange(99)]), rng.choice([None, "a", "b"]), rng.choice(["delete", "insert", "update", "update"]), 100 * b + k) for k in range(15)] for b in range(n)]


def rows_of(df):
    return {r.k: (r.x, r.y) for r in df.collect()}


def test_phases_of_a_batch(spark):
    for seed in range(3):
        first, second, _ = batches(seed)
        want = plainly(plainly({}, first), second)
        table = spark.createDataFrame([], TABLE)
        for b in (first, second):
            table = ingest.merge_batch(table, spark.createDataFrame(b, CHANGE), "k")
        assert rows_of(table) == want


def test_a_killed_run_ends_the_same(spark, tmp_path, monkeypatch):
    """The process dies between the data and the pointer of the second batch, and once more before its data."""
    work = batches(7)
    for k, b in enumerate(work):
        spark.createDataFrame(b, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    root, state = f"{tmp_path}/table", f"{tmp_path}/state"

    def stream():
        return spark.readStream.schema(spark.createDataFrame([], CHANGE).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    flip, write, calls = ingest.flip, ingest.write_version, []

    def dying_flip(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        flip(*args)

    monkeypatch.setattr(ingest, "flip", dying_flip)
    with pytest.raises(StreamingQueryException):
        ingest.ingest(stream(), root, state, TABLE, "k")
    before = rows_of(ingest.current(spark, root, TABLE))
    monkeypatch.setattr(ingest, "write_version", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(StreamingQueryException):
        ingest.ingest(stream(), root, state, TABLE, "k")
    assert rows_of(ingest.current(spark, root, TABLE)) == before
    monkeypatch.setattr(ingest, "write_version", write)
    ingest.ingest(stream(), root, state, TABLE, "k")
    orders = [[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]  # files written within one second come in any order
    wants = []
    for order in orders:
        want = {}
        for k in order:
            want = plainly(want, work[k])
        wants.append(want)
    got = rows_of(ingest.current(spark, root, TABLE))
    assert got in wants
    ingest.ingest(stream(), root, state, TABLE, "k")  # nothing new
    assert rows_of(ingest.current(spark, root, TABLE)) == got


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first, second, _ = (spark.createDataFrame(b, CHANGE) for b in batches(3))
    root = f"{tmp_path}/t"
    for number, batch in ((0, first), (1, second), (1, second)):
        ingest.commit(root, batch, number, TABLE, "k")
    b = batches(3)
    assert rows_of(ingest.current(spark, root, TABLE)) == plainly(plainly({}, b[0]), b[1])
    gone = spark.createDataFrame([(k, None, None, "delete", 900) for k in range(12)], CHANGE)
    ingest.commit(root, gone, 2, TABLE, "k")
    assert rows_of(ingest.current(spark, root, TABLE)) == {}


def test_figures_kept_up_equal_a_full_fold(spark):
    rng = random.Random(11)
    kind = "path string, size long, mtime_s long"
    path = lambda: "/".join([*(rng.choice("abc") for _ in range(rng.randint(0, 3))), f"f{rng.randrange(40)}"])
    now = {path(): (rng.randrange(9), rng.randrange(50)) for _ in range(60)}
    stored = fold.totals(spark.createDataFrame([(p, *v) for p, v in now.items()], kind))
    for _ in range(3):
        stored = spark.createDataFrame(stored.collect(), stored.schema)
        after = dict(now)
        for p in rng.sample(sorted(after), 8):
            del after[p]
        for p in rng.sample(sorted(after), 8):
            after[p] = (rng.randrange(9), rng.choice([after[p][1], rng.randrange(50)]))
        for _ in range(5):
            after.setdefault(path(), (1, rng.randrange(-5, 60)))
        gone = [(p, *v) for p, v in now.items() if after.get(p) != v]
        come = [(p, *v) for p, v in after.items() if now.get(p) != v]
        table = spark.createDataFrame([(p, *v) for p, v in after.items()], kind)
        stored = fold.refold(stored, spark.createDataFrame(gone, kind), spark.createDataFrame(come, kind), table)
        want = {(r.ancestor, r.files, r.bytes, r.oldest, r.newest) for r in fold.totals(table).collect()}
        assert {(r.ancestor, r.files, r.bytes, r.oldest, r.newest) for r in stored.collect()} == want
        now = after
    empty = spark.createDataFrame([], kind)
    rows = spark.createDataFrame([(p, *v) for p, v in now.items()], kind)
    assert fold.refold(fold.totals(rows), rows, empty, empty).where(F.col("files") >= 0).count() == 0
