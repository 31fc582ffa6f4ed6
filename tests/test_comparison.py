"""The comparison of two sides against its SQL, on texts of no characters, without a size, and with repeated ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Documents of which every fifth has no text, some have no size, and some ids occur three times."""
    at = tmp_path_factory.mktemp("odd")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    none = F.col("doc_id") % 5 == 0
    d = d.withColumns({"text": F.when(none, "").otherwise(F.col("text")), "n_chars": F.when(none, 0).when(F.col("doc_id") % 23 == 1, None).otherwise(F.col("n_chars"))})
    other = lambda n: d.where(f"doc_id % 9 = {n}").withColumns({"text": F.concat("text", F.lit("x" * n)), "n_chars": F.col("n_chars") + n, "source": F.concat(F.lit("src"), F.lit(str(n)))})
    d.unionByName(other(4)).unionByName(other(7)).unionByName(other(4).withColumn("source", F.lit("src5"))).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["cp1_identical", "cp2_different", "cp3_only", "cp4_drop_wrapper", "cp5_summary"])
def test_rows_equal_the_sql(spark, odd, name):
    got = registry.QUERIES[name](spark, odd)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    found = con.execute(registry.ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    want = Counter(tuple(r[k] for k in at) for r in found.fetchall())
    assert Counter(map(tuple, got.collect())) == want and want
