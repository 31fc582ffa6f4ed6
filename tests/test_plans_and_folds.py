"""Folds, decisions and plans on small hand-made trees: two volumes, last copies, free names, schedules, notable lists."""

import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.operators import changes, fold, intent, places

TWO = [("p", "a/x", 1, 5, "m"), ("p", "a/b/y", 2, 9, "d"), ("q", "a/x", 10, 3, "d"), ("q", "z", 20, 4, "m")]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(TWO, "source_id string, path string, size long, mtime_s long, family string").cache()


def test_equal_paths_of_two_volumes_are_two_folders(spark, two):
    by = ["source_id"]
    assert {(r.source_id, r.ancestor): r.bytes for r in fold.totals(two, by=by).collect()} == {("p", ""): 3, ("p", "a"): 3, ("p", "a/b"): 2, ("q", ""): 30, ("q", "a"): 10}
    assert {(r.source_id, r.ancestor, r.family): r.bytes for r in fold.breakdown(two, "family", by).where("ancestor = 'a'").collect()} == {("p", "a", "m"): 1, ("p", "a", "d"): 2, ("q", "a", "d"): 10}
    assert {(r.source_id, r.ancestor): r.family for r in fold.main_kind(two, "family", by).where("ancestor = 'a'").collect()} == {("p", "a"): "d", ("q", "a"): "d"}
    groups = spark.createDataFrame([("p", "a", "d")], "source_id string, group_path string, group_family string")
    shown = {(r.source_id, r.ancestor, r.shown): r.bytes for r in fold.composition(two, groups, by).collect()}
    assert shown[("p", "", "d")] == 3 and shown[("q", "", "d")] == 10 and shown[("q", "", "m")] == 20
    first = fold.top_per_folder(two, 1, F.desc("size"), by=by).where("ancestor = ''").collect()
    assert {(r.source_id, r.path) for r in first} == {("p", "a/b/y"), ("q", "z")}


def test_decisions_of_one_volume_do_not_reach_the_other(spark, two):
    by = ["source_id"]
    own = spark.createDataFrame([("p", "a", "keep"), ("q", "", "discard")], "source_id string, own_path string, own_decision string")
    assert {(r.source_id, r.path): r.decision for r in intent.effective_decisions(two, own, by).collect()} == {("p", "a/x"): "keep", ("p", "a/b/y"): "keep", ("q", "a/x"): "discard", ("q", "z"): "discard"}
    tags = spark.createDataFrame([("p", "a", "t")], "source_id string, own_path string, tag string")
    assert {(r.source_id, r.path) for r in intent.effective_tags(two, tags, by).collect()} == {("p", "a/x"), ("p", "a/b/y")}
    picked = spark.createDataFrame([("p", "a"), ("p", "a/x"), ("q", "a/x")], "source_id string, path string")
    assert {tuple(r) for r in intent.topmost(picked, by=by).collect()} == {("p", "a"), ("q", "a/x")}
    found = intent.rescue(two.select("source_id", "path", F.col("size").alias("bytes")), picked.where("path = 'a'"), by)
    assert {(r.source_id, r.group_path, r.path) for r in found.collect()} == {("p", "a", "a/x"), ("p", "a", "a/b/y")}


def test_changes_are_told_by_volume(spark):
    kind = "source_id string, path string, kind string, size long, mtime_ns long"
    old = spark.createDataFrame([("p", "a", "file", 1, 1), ("q", "b", "file", 1, 1)], kind)
    new = spark.createDataFrame([("q", "a", "file", 1, 1), ("q", "b", "file", 2, 1)], kind)
    assert {(r.source_id, r.path): r.op for r in changes.snapshot_diff(old, new, by=["source_id"]).collect()} == {("p", "a"): "missing", ("q", "a"): "insert", ("q", "b"): "update"}
    merged = changes.merge_draft(new.select("source_id", F.lit("d/1").alias("path")), old.select("source_id", F.lit("d/1").alias("path")).where("source_id = 'p'"), ["source_id"])
    assert {(r.source_id, r.op, r.path) for r in merged.collect()} == {("q", "mkdir", "d"), ("q", "rename", "d/1")}
    items = spark.createDataFrame([("p", 1, "a/x"), ("q", 2, "a/x")], "source_id string, entry_id long, origin string")
    assert {r.entry_id: r.state for r in changes.restore_draft(items, spark.createDataFrame([("p", "a/x"), ("q", "a/y")], "source_id string, path string"), by=["source_id"]).collect()} == {1: "taken", 2: "planned"}


def test_the_last_readable_copy_stays(spark):
    """Pending names are no copies, names of one inode are names, and members go with their archive."""
    columns = "entry_id long, source_id string, path string, digest string, content_state string, state string, ino int, nlink int"
    rows = [
        (1, "s", "a", "k", "hashed", "present", 1, 1), (2, "s", "b", "k", "hashed", "present", 2, 1), (3, "s", "c", None, "pending", "present", 3, 1),
        (4, "s", "d", "m", "hashed", "present", 9, 2), (5, "s", "e", "m", "hashed", "present", 9, 2), (6, "s", "f", "n", "hashed", "present", 6, 1),
        (7, "s", "g.zip", "z", "hashed", "present", 7, 1), (8, "s", "h", "o", "hashed", "present", 8, 1), (9, "t", "a", "o", "hashed", "unreadable", 1, 1),
    ]
    files = spark.createDataFrame(rows, columns).selectExpr("*", "5L as size", "true as stable", "true as online", "false as quarantined", "1 as dev")
    members = spark.createDataFrame([(1, 7, "x", None, 5, "hashed", "n")], "member_id long, archive_id long, path string, link_path string, size long, content_state string, digest string")
    copy = places.copies(files, places.placed_members(members, spark.createDataFrame([(7, "complete")], "archive_id long, listing string"), files))

    def refused(*ids):
        gone = files.where(F.col("entry_id").isin(list(ids))).select("entry_id", "source_id", "path")
        return {r.entry_id for r in changes.last_copies(gone, copy).collect() if r.refused}

    assert refused(1, 2, 3) == {2}
    assert refused(1) == set()
    assert refused(4, 5) == {5} and refused(4) == set()
    assert refused(6) == set() and refused(6, 7) == {6, 7}
    assert refused(8) == {8}


def test_free_names(spark):
    moves = [(1, 1, "d", "a.txt", "x"), (2, 2, "d", "a.txt", "y"), (3, 3, "d", "a.txt", "z"), (4, 4, "d", "a.txt", "w"), (5, 5, "e", "a.txt", None), (6, 6, "d", "a (3).txt", None), (7, 7, "d", "b", None), (8, 8, "d", "b", None), (9, 9, "d", ".c", None), (10, 10, "d", ".c", None), (11, 11, "e", "a.txt", "q"), (12, 12, "e", "a.txt", "q")]
    present = [("d", "a.txt", "y"), ("d", "a (2).txt", None), ("d", "b", None)]
    got = changes.free_names(spark.createDataFrame(moves, "entry_id long, seq long, dest string, name string, digest string"), spark.createDataFrame(present, "dest string, name string, digest string")).collect()
    assert {r.entry_id: (r.free_name, r.reason) for r in got} == {
        1: ("a (1).txt", None), 2: (None, "identical_copy"), 3: ("a (4).txt", None), 4: ("a (5).txt", None), 5: ("a.txt", None), 6: ("a (3).txt", None),
        7: ("b (1)", None), 8: ("b (2)", None), 9: (".c", None), 10: (".c (1)", None), 11: ("a (1).txt", None), 12: ("a (2).txt", None),
    }
    long = "x" * 252
    many = [(k, k, "d", "n", None) for k in range(1002)] + [(2000 + k, k, "d", long, None) for k in range(2)]
    got = {r.entry_id: (r.free_name, r.reason) for r in changes.free_names(spark.createDataFrame(many, "entry_id long, seq long, dest string, name string, digest string"), spark.createDataFrame([], "dest string, name string, digest string")).collect()}
    assert got[0] == ("n", None) and got[999] == ("n (999)", None) and got[1000] == (None, "name_taken") and got[2001] == (None, "name_taken")
    names = [n for n, _ in got.values() if n]
    assert len(set(names)) == len(names)


def test_next_runs_over_changes_of_the_clock(spark):
    ny, be = "America/New_York", "Europe/Berlin"
    rows = [
        ("2024-03-10 06:00:00", ny, 2, 30, None, "2024-03-10 07:30:00"),  # 02:30 is skipped: 03:30 summer time
        ("2024-03-09 07:30:00", ny, 2, 30, None, "2024-03-10 07:30:00"),
        ("2024-11-03 05:00:00", ny, 1, 30, None, "2024-11-03 05:30:00"),  # the first of two
        ("2024-11-03 05:30:00", ny, 1, 30, None, "2024-11-04 06:30:00"),  # and once only
        ("2024-03-29 12:00:00", be, 9, 0, 7, "2024-03-31 07:00:00"),
        ("2024-03-31 07:00:00", be, 9, 0, 7, "2024-04-07 07:00:00"),
        ("2024-10-26 20:00:00", be, 23, 59, 7, "2024-10-27 22:59:00"),
        ("2024-01-01 00:00:00", "UTC", 0, 0, None, "2024-01-02 00:00:00"),
    ]
    t = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, at string, zone string, hour int, minute int, weekday int, want string")
    got = {r.k: r.next_at for r in changes.next_runs(t.withColumn("after", F.col("at").cast("timestamp_ntz"))).collect()}
    assert got == {k: datetime.fromisoformat(r[-1]) for k, r in enumerate(rows)}


def notable_plainly(entries, groups, families, most):
    """Recursion from the root, every list built from whole folders."""
    files, subs, folders = defaultdict(list), defaultdict(set), {""}
    for path, size, family in entries:
        parts = path.split("/")
        files["/".join(parts[:-1])].append((path, size, family))
        for k in range(1, len(parts)):
            subs["/".join(parts[: k - 1])].add("/".join(parts[:k]))
            folders.add("/".join(parts[:k]))
    under = {f: [e for e in entries if f == "" or e[0].startswith(f + "/")] for f in folders}
    amount = lambda f, x: sum(s for _, s, g in under[f] if g == x)
    total = lambda f: sum(s for _, s, _ in under[f])

    def inside(f, against):
        out = [(p, s, False) for p, s, g in files[f] if g != against]
        for c in subs[f]:
            out += [(c, total(c), True)] if c in groups or 2 * amount(c, against) < total(c) else inside(c, against)
        return sorted(out, key=lambda r: (-r[1], r[0]))[:most]

    found = set()
    for f in folders:
        if total(f):
            main = max(families, key=lambda x: (amount(f, x), -families.index(x)))
            found |= {(f, *r, k + 1) for k, r in enumerate(inside(f, main))}
    return found


@pytest.mark.parametrize("seed", range(2))
def test_notable_equals_recursion(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    entries = sorted({("/".join(rng.choice(names) for _ in range(rng.randint(0, 3))) + f"/f{k}").lstrip("/"): (rng.randint(0, 9), rng.choice("xyz")) for k in range(60)}.items())
    entries = [(p, s, f) for p, (s, f) in entries]
    groups = {"a/b", "c"}
    t = spark.createDataFrame(entries, "path string, size long, family string")
    g = spark.createDataFrame([(x,) for x in groups], "path string")
    got = {tuple(r) for r in fold.notable(t, g, ["x", "y", "z"], 4).collect()}
    assert got == notable_plainly(entries, groups, ["x", "y", "z"], 4)
    assert fold.notable(t.limit(0), g, ["x", "y", "z"]).count() == 0


def test_all_figures_of_a_folder(spark):
    day = 86_400_000_000_000
    rows = [
        ("a", "directory", "present", False, False, 0, 0), ("a/b", "directory", "unreadable", False, False, 0, 0), ("a/m", "directory", "present", True, False, 0, 0), ("a/e", "directory", "present", False, True, 0, 0),
        ("a/1", "file", "present", False, False, 5, 1), ("a/2", "file", "unreadable", False, False, 7, 3 * day), ("a/l", "symlink", "present", False, False, 99, 5 * day), ("s", "other", "present", False, False, 0, 0),
    ]
    t = spark.createDataFrame(rows, "path string, kind string, state string, mount boolean, partial boolean, size long, mtime_ns long")
    got = {r.ancestor: r for r in fold.figures(t).collect()}
    root, a = got[""], got["a"]
    assert (root.folders, root.symlinks, root.specials, root.unreadable, root.mounts, root.partial, root.files, root.bytes, root.oldest, root.newest) == (4, 1, 1, 2, 1, True, 2, 12, 3 * day, 3 * day)
    assert (a.folders, a.specials, a.files, a.partial) == (3, 0, 2, True)
    assert got["a/b"].partial and got["a/e"].partial and not got["a/m"].partial and got["a/m"].files == 0


def test_what_could_not_be_seen_rises(spark):
    rows = spark.createDataFrame([("s", "a/b/x", "present"), ("s", "c/y", "unreadable"), ("t", "a/b/x", "present"), ("s", "d/z", "present")], "source_id string, path string, state string")
    partial = spark.createDataFrame([("s", "a/b/deep"), ("t", "q")], "source_id string, path string")
    got = {(r.source_id, r.ancestor): r.blind for r in places.blind(rows, partial).collect()}
    assert got == {("s", ""): True, ("s", "a"): True, ("s", "a/b"): True, ("s", "c"): True, ("s", "d"): False, ("t", ""): True, ("t", "a"): False, ("t", "a/b"): False}


def test_composition_of_nested_groups_goes_up_by_levels(spark):
    """Groups in groups, a group without a family, and no window over all files' ancestors."""
    rows = [("a/b/c/1", "F", 1), ("a/b/c/2", "O", 2), ("a/b/3", "F", 4), ("a/d/4", "O", 8), ("e/5", None, 16), ("6", "F", 32)]
    t = spark.createDataFrame(rows, "path string, family string, size long")
    g = spark.createDataFrame([("a/b", "B"), ("a/b/c", "C"), ("a/d", None)], "group_path string, group_family string")
    found = fold.composition(t, g)
    assert {(r.ancestor, r.shown): r.bytes for r in found.collect()} == {
        ("", "B"): 7, ("", "O"): 8, ("", None): 16, ("", "F"): 32, ("a", "B"): 7, ("a", "O"): 8, ("a/b", "C"): 3, ("a/b", "F"): 4,
        ("a/b/c", "F"): 1, ("a/b/c", "O"): 2, ("a/d", "O"): 8, ("e", None): 16,
    }
    assert "Window" not in found._jdf.queryExecution().toString()
