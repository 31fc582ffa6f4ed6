"""Review operators on small hand-made tables."""

import pytest

from granary.operators import review

ROWS = "folder string, key string, size long"


def test_an_unpacked_archive_is_listed_once_with_its_twin_first(spark):
    z = spark.createDataFrame([("z1", "a", 1), ("z1", "b", 2), ("z2", "a", 1), ("z3", "q", 9), ("z4", "a", 1), ("z4", "b", 2)], ROWS)
    f = spark.createDataFrame([("d/big", "a", 1), ("d/big", "b", 2), ("d/big", "c", 3), ("e", "a", 1), ("e", "b", 2), ("f", "a", 1), ("f", "b", 2)], ROWS)
    got = {r.archive: (r.folder, r.same) for r in review.unpacked(z, f).collect()}
    assert got == {"z1": ("e", True), "z4": ("e", True), "z2": ("d/big", False)}


def test_a_larger_folder_before_a_twin_then_the_deepest(spark):
    rows = [("x", "a", 1), ("y", "a", 1), ("w/v", "a", 1), ("big", "a", 1), ("big", "b", 1), ("p", "c", 1), ("q/r", "c", 1), ("none", None, 4)]
    got = {r.folder: (r.partner, r.twin) for r in review.picked(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"x": ("big", False), "y": ("big", False), "w/v": ("big", False), "p": ("q/r", True), "q/r": ("p", True)}


def test_chains_of_lone_folders(spark):
    t = spark.createDataFrame([("a/b/c/1",), ("a/b/c/2",), ("d/e/3",), ("d/4",)], "path string")
    got = {r.folder: (r.lifted, r.lowered) for r in review.chains(t).collect()}
    assert got == {"a": ("a", "a/b/c"), "a/b": ("a", "a/b/c"), "a/b/c": ("a", "a/b/c"), "d": ("d", "d"), "d/e": ("d/e", "d/e")}


def test_copies_inside_a_relation_leave_one_standing(spark):
    c = spark.createDataFrame(
        [("k", 5, "1", "s", "in/1"), ("k", 5, "2", "s", "in/2"), ("k", 5, "3", "s", "out/3"), ("m", 7, "4", "s", "out/4"), ("m", 7, "5", "t", "5"), ("n", 1, "6", "s", "in/6"), ("n", 1, "7", "s", "in/7")],
        "digest string, size long, pkey string, source_id string, at_path string",
    )
    sides = spark.createDataFrame([("s/in",)], "folder string")
    assert {(r.digest, r.files, r.bytes) for r in review.duplicate_groups(c, sides).collect()} == {("k", 1, 5), ("m", 1, 7)}


def test_rescue_takes_the_outermost_keeps_of_each_folder(spark):
    keeps = spark.createDataFrame([("a/b/c",), ("a/b/c/d",), ("a/x",)], "path string")
    got = {(r.folder, r.path) for r in review.rescue_plan(spark.createDataFrame([("a",), ("a/b/c",), ("z",)], "folder string"), keeps).collect()}
    assert got == {("a", "a/b/c"), ("a", "a/x"), ("a/b/c", "a/b/c/d")}


def test_a_linked_file_is_freed_with_its_last_name(spark):
    rows = [("s", 1, 1, 2, True, 1, 10), ("s", 1, 1, 2, True, 2, 10), ("s", 1, 9, 2, True, 3, 4), ("s", 1, 7, 2, False, 4, 3)]
    t = spark.createDataFrame(rows, "source_id string, dev int, ino int, nlink int, stable boolean, entry_id int, size long")
    assert [(r.files, r.bytes, r.freed) for r in review.freed(t, "source_id").collect()] == [(4, 27, 13)]


@pytest.mark.parametrize("f", [review.picked, review.listed, lambda d: review.unpacked(d, d)])
def test_no_rows(spark, f):
    assert f(spark.createDataFrame([], ROWS)).count() == 0
