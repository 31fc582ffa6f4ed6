"""Work on each row is dealt over the cores, and no folder gathers all rows below it."""

import datetime

from pyspark.sql import functions as F

from granary.functions import paths, runs
from granary.operators import changes, dates, fold, intent
from granary.sources import adapters


def test_dates_and_schedules_are_dealt_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    shots = spark.range(20).coalesce(1).selectExpr("id AS photo_id", "'2023/IMG_20230102_030405.jpg' AS path", "id AS exif_ns", "true AS offset_known", "null AS gps_ns", "null AS container_ns", "id AS mtime_ns")
    assert dates.candidates(shots, 1_706_400_000_000_000_000, 2024).rdd.getNumPartitions() >= cores
    runs = spark.range(20).coalesce(1).selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS after", "'UTC' AS zone", "3 AS hour", "4 AS minute", "cast(null AS bigint) AS weekday")
    found = changes.next_runs(runs)
    assert found.rdd.getNumPartitions() >= cores
    assert {r.next_at for r in found.collect()} == {datetime.datetime(2024, 1, 1, 3, 4)}


def test_names_with_thousandths_and_days(spark):
    names = {"PXL_20230102_030405678.jpg": ("second", 678), "VID-20230102-WA7.mp4": ("day", 0), "img_20230102_0304057.jpg": None, "Screenshot_2023-01-02-03-04-05.png": ("second", 0), "pxl_20230102_0304056789.jpg": None}
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("d", dates.name_date(F.col("name"))).collect()
    assert {r["name"]: r.d and (r.d.precision, r.d.ns // 1_000_000 % 1000) for r in rows} == names


def test_lost_extremes_are_found_before_any_join(spark):
    """Joined first, every entry would travel to the task that has the root."""
    rows = spark.createDataFrame([(f"a/{k % 3}/{k}", 1, k) for k in range(30)], "path string, size long, mtime_s long")
    after = rows.where("mtime_s < 29")
    out = fold.refold(fold.totals(rows), rows.where("mtime_s = 29"), rows.where("false"), after)
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    key = ["ancestor", "level", "files", "bytes", "oldest", "newest"]
    assert sorted(out.select(*key).collect()) == sorted(fold.totals(after).select(*key).collect())


def test_rows_below_a_crowded_folder_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(paths, "CROWDED", 3)
    rows = spark.createDataFrame([(f"a/{k % 3}/{k}", k) for k in range(30)] + [("b/x", 1), ("b/x/y", 2), ("a/1", 3)], "path string, bytes long")
    groups = spark.createDataFrame([("a",), ("a/2",), ("b/x",), ("c",)], "path string")
    assert intent.topmost(rows)._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2  # none before
    under = {r.path: r.group_path for r in intent.rescue(rows, groups).collect()}
    assert under == {**{f"a/{k % 3}/{k}": "a" for k in range(30) if k % 3 != 1}, "a/1": "a", "b/x/y": "b/x"}
    found = paths.above(rows, groups.withColumnRenamed("path", "ancestor"))
    plain = paths.with_ancestors(rows, True).join(groups, F.col("ancestor") == groups["path"], "left_semi")
    columns = ["path", "bytes", "level", "ancestor"]
    assert sorted(found.select(*columns).collect()) == sorted(plain.select(*columns).collect())


def test_large_tables_are_joined_in_more_tasks(spark, sf, monkeypatch):
    few = adapters.tree_orders(spark, sf)
    monkeypatch.setattr(runs, "TASK_ROWS", 100)
    many = adapters.tree_orders(spark, sf)
    lines = adapters.table(spark, sf, "lineitem")
    assert runs.dealt(lines, "l_orderkey").rdd.getNumPartitions() == -(-lines.count() // 100)
    dealt = [d._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") for d in (few, many)]
    assert dealt == [0, 2]  # none before
    assert sorted(many.collect()) == sorted(few.collect())


def test_groups_of_any_size_are_reduced_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(runs, "TASK_ROWS", 160)
    rows = spark.range(4000).selectExpr("if(id < 2000, 'crowded', concat('k', id % 150)) AS key", "id AS n", "cast(id AS string) AS path").coalesce(2)
    read = []

    def summed(some, key):
        sizes = some.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        read.append((len(key), sizes))
        return some.groupBy(*key).agg(F.sum("n").alias("n"), F.min("path").alias("path"))

    got = {r["key"]: r.n for r in runs.reduced(rows, ["key"], "path", summed).collect()}
    assert got == {r["key"]: r.n for r in rows.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert [k for k, _ in read] == [2, 1] and max(n for _, n in read) < 500  # one task would read the 2000


def test_notable_lists_are_made_in_more_tasks(spark, monkeypatch):
    entries = [(f"{k % 3}/{k % 40}/{k}", k % 11, "xyz"[k % 7 % 3]) for k in range(600)] + [(f"1/f{k}", 3, "x") for k in range(100)]
    t = spark.createDataFrame(entries, "path string, size long, family string")
    g = spark.createDataFrame([("1/5",), ("2",), ("none/here",)], "path string")
    few = fold.notable(t, g, ["x", "y"], 4).collect()
    monkeypatch.setattr(runs, "TASK_ROWS", 20)
    many = fold.notable(t, g, ["x", "y"], 4)
    assert sorted(many.collect()) == sorted(few)
    largest = many.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert len(few) > 300 and largest < 100  # all in one task before
