"""Ids beyond those whose times a long can hold: the queries that read times of files answer for every row."""

import pytest
from pyspark.sql import functions as F

from granary.plans import registry

LARGEST = 23058  # times 4e14 is the last that a long holds


@pytest.fixture(scope="module")
def large(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("large")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rest = [c for c in d.columns if c != "doc_id"]
    ids = spark.createDataFrame([(k, i) for k, i in enumerate((1, LARGEST - 1, LARGEST, LARGEST + 1, LARGEST + 5, 51282, 600_000, 600_001))], "k long, doc_id long")
    d.where("doc_id < 8").select(F.col("doc_id").alias("k"), *rest).join(ids, "k").drop("k").select(*d.columns).write.parquet(f"{at}/documents.parquet")
    assert spark.read.parquet(f"{at}/documents.parquet").count() > 5
    return str(at)


@pytest.mark.parametrize("name", ["a1_figures", "f7_years", "pj17_age_band", "pj7_known_time", "pj9_year_range", "s3_diff", "t3_figure_diff", "x18_first_difference"])
def test_times_of_large_ids(spark, large, name):
    rows = registry.QUERIES[name](spark, large).collect()
    ids = {r[0] for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id").collect()}
    if name in ("pj17_age_band", "pj7_known_time"):
        assert {r["entry_id"] for r in rows} == ids
    if name == "pj7_known_time":
        times = {r["entry_id"]: r["mtime_ns"] for r in rows}
        for i in ids:
            ns = i % (LARGEST + 1) * 400_000_000_000_000
            assert times[i] == (ns if ns else None)
    if name == "s3_diff":
        assert len(rows) == sum(1 for i in ids if i % 10 or i % 9)
