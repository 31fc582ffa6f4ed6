"""What filters keep: no text that nothing equals is lost, and none is kept twice."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import exact_dedup, language_id, merkle, mixing, near_dedup, simhash
from granary.llm.common import text_name

LONG = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "a wholly different text about other things that nobody else has written so far today"
CLASHING = "name, row_id, times, turn, language_found, rounded, rate, granary_copies, granary_copy, granary_language, granary_rank, gone_id, kept, n, node, body, id"


def rated(rows):
    return mixing.resample(rows, rows.select("doc_id", text_name("text").alias("name"), F.when(F.col("text") == "b", 0.0).otherwise(1.0).alias("rate")).distinct())


FILTERS = {
    "exact": exact_dedup.drop_exact_copies,
    "near": near_dedup.drop_near_copies,
    "simhash": simhash.drop_near_copies,
    "resample": rated,
}
WANT = {
    "exact": [(0, "b"), (1, LONG), (1, OTHER), (2, "c")],
    "near": [(0, "b"), (1, LONG), (1, OTHER), (2, "c")],
    "simhash": [(0, "b"), (1, LONG), (1, OTHER), (2, "c")],
    "resample": [(1, LONG), (1, OTHER), (2, "c"), (2, "c"), (3, LONG)],
}


def table(spark, rows, kind="long", extra=CLASHING):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(c).alias(c) for c in extra.split(", ") if c))


@pytest.mark.parametrize("name", FILTERS)
def test_a_dropped_id_loses_no_other_text(spark, name):
    rows = table(spark, [(0, "b"), (1, "b"), (1, LONG), (1, OTHER), (2, "c"), (2, "c"), (3, LONG)]).repartition(3)
    left = FILTERS[name](rows)
    assert left.columns == rows.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(WANT[name])
    assert all(r[c] == c for r in left.collect() for c in CLASHING.split(", "))


@pytest.mark.parametrize("name", FILTERS)
def test_null_ids_stay_and_nothing_of_nothing(spark, name):
    rows = table(spark, [(None, LONG), (None, LONG), (5, LONG), (7, None), (8, "")])
    left = sorted(((r.doc_id, r.text) for r in FILTERS[name](rows).collect()), key=str)
    assert left.count((None, LONG)) == 2 and (5, LONG) in left and (7, None) in left
    assert FILTERS[name](rows.limit(0)).count() == 0


@pytest.mark.parametrize("kind, ids", [("decimal(20,0)", [decimal.Decimal(k) for k in range(3)]), ("date", [datetime.date(2020, 1, k + 1) for k in range(3)]), ("smallint", [0, 1, 2]), ("string", ["0", "1", "2"])])
def test_ids_of_any_type(spark, kind, ids):
    rows = table(spark, [(ids[0], "b"), (ids[1], "b"), (ids[1], OTHER), (ids[2], LONG)], kind)
    for name in ("exact", "near", "simhash"):
        assert sorted((r.doc_id, r.text) for r in FILTERS[name](rows).collect()) == [(ids[0], "b"), (ids[1], OTHER), (ids[2], LONG)]
    assert sorted(r.doc_id for r in merkle.compare_with_next(rows).collect()) == sorted(r.doc_id for r in rows.collect())


def test_language_filter_keeps_clashing_columns(spark):
    rows = table(spark, [(k, "the cat and the dog are here") for k in range(20)] + [(30, "12345 67890")])
    left = language_id.drop_unknown_language(rows)
    assert left.columns == rows.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(20))
    assert {r.language_found for r in left.collect()} == {"language_found"}


def test_pipeline_of_nothing_and_of_repeated_ids(spark, sf):
    for rows in ([], [(0, "b"), (1, LONG), (1, OTHER), (1, OTHER)]):
        docs = table(spark, rows, extra="")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == len(set(rows))


def test_near_copies_share_a_key_wherever_they_differ():
    """Keys once were least values under 96 random orders: a set and the same one without these had none in common."""
    draw = np.random.default_rng(64).integers
    factor, offset = draw(0, 1 << 63, 96, np.uint64) * np.uint64(2) + np.uint64(1), draw(0, 1 << 64, 96, np.uint64)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 2000, np.uint64)
    other = np.delete(base, (base[:, None] * factor + offset).argmin(axis=0))
    assert len(other) > 1900
    full = rng.integers(0, 9, near_dedup.SLOTS)
    for by in (None, full):
        assert set(near_dedup.keys_of(base, by)) & set(near_dedup.keys_of(other, by))
        for n in range(1, 400, 7):
            whole = base[:n]
            # at worst, all that only one of them has comes first in the order
            mixed = whole * near_dedup.FACTOR + near_dedup.OFFSET
            ranked = whole[np.argsort(mixed) if by is None else np.lexsort((mixed, by[near_dedup._slot(whole)]))]
            assert set(near_dedup.keys_of(whole, by)) & set(near_dedup.keys_of(ranked[n // 5 :], by))
            assert len(near_dedup.keys_of(whole, by)) == n // 5 + 1
