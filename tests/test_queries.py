"""Registered queries against their SQL on DuckDB, and small hand-made trees."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.functions.runs import numbered
from granary.functions.scalars import preview_text, shown
from granary.operators import changes, fold, intent, places, relations, search
from granary.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert mine
        return
    found = con.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert mine == sorted((tuple(plain(r[k]) for k in at) for r in found.limit(10**9).fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_root_holds_everything(spark):
    rows = [("a/x.jpg", 10, 5), ("a/b/y.txt", 5, 0), ("a0/z", 7, 9)]
    t = spark.createDataFrame(rows, "path string, size long, mtime_s long")
    got = {r.ancestor: (r.files, r.bytes) for r in fold.totals(t).collect()}
    assert got == {"": (3, 22), "a": (2, 15), "a/b": (1, 5), "a0": (1, 7)}


def test_group_hides_its_mix_from_above(spark):
    t = spark.createDataFrame([("Games/Foo/p.jpg", 3, "media"), ("Games/Foo/f.exe", 9, "program")], "path string, size long, family string")
    g = spark.createDataFrame([("Games/Foo", "program")], "group_path string, group_family string")
    got = {(r.ancestor, r.shown): r.bytes for r in fold.composition(t, g).collect()}
    assert got == {("", "program"): 12, ("Games", "program"): 12, ("Games/Foo", "media"): 3, ("Games/Foo", "program"): 9}


def test_nearest_decision_wins(spark):
    e = spark.createDataFrame([("a/x",), ("a/b/y",), ("a/b/c/z",), ("q/w",)], "path string")
    own = spark.createDataFrame([("a", "keep"), ("a/b", "discard"), ("a/b/c", "undecided")], "own_path string, own_decision string")
    got = {r.path: r.decision for r in intent.effective_decisions(e, own).collect()}
    assert got == {"a/x": "keep", "a/b/y": "discard", "a/b/c/z": "undecided", "q/w": "undecided"}
    assert {r.path for r in intent.topmost(spark.createDataFrame([("a",), ("a/b",), ("a0",)], "path string")).collect()} == {"a", "a0"}


def test_compare_buckets(spark):
    """Pairs in path order, surplus copies with a twin, and what sizes and unread files leave open."""
    kind = "path string, size long, content_state string, digest string"
    left = [("1", 1, "hashed", "k"), ("2", 1, "hashed", "k"), ("3", 2, "hashed", "m"), ("4", 3, "hashed", "n"), ("5", 7, "pending", None), ("6", 0, None, None), ("7", 9, "sampled", None), ("8", 4, "pending", None)]
    right = [("9", 1, "hashed", "k"), ("3", 2, "hashed", "o"), ("5", 8, "pending", None), ("e", 0, None, None), ("f", 3, "pending", None), ("8", 4, "hashed", "q"), ("g", 5, "hashed", "r")]
    got = relations.compare(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind))
    assert sorted(((r.bucket, r.left_path, r.right_path, r.size, r.twin) for r in got.collect()), key=str) == sorted([
        ("identical", "1", "9", 1, None), ("identical", "2", None, 1, "9"), ("identical", "6", "e", 0, None),
        ("different", "3", "3", 2, None), ("different", "5", "5", 7, None),
        ("unchecked", "4", None, 3, None), ("unchecked", "8", None, 4, None), ("unchecked", None, "8", 4, None), ("unchecked", None, "f", 3, None),
        ("only_left", "7", None, 9, None), ("only_right", None, "g", 5, None),
    ], key=str)
    opened = {r.bucket: (r.files, r.bytes, r.opened) for r in relations.summary(got).collect()}
    assert opened == {"only_left": (1, 9, True), "only_right": (1, 5, False), "different": (2, 9, False), "unchecked": (4, 14, False), "identical": (3, 2, False)}
    none = relations.summary(relations.compare(spark.createDataFrame([], kind), spark.createDataFrame([], kind)))
    assert [r.bucket for r in none.where("opened").collect()] == ["only_left"]


def test_numbers_of_a_group_over_many_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id, -1) as g", "(id * 7919) % 3001 as v").repartition(6)
    got = numbered(rows, ["g"], ["v"], "place").collect()
    assert all(r.place == 1 for r in got if r.g >= 0)
    hot = sorted((r.v, r.place) for r in got if r.g < 0)
    assert [p for _, p in hot] == list(range(1, 2001))


def test_chains_of_links(spark):
    """Five links to one file, a link to nothing, a circle, and a chain of forty."""
    rows = [(1, "f", None, 9, "hashed", "d")] + [(1, f"l{k}", f"l{k - 1}" if k else "f", 0, None, None) for k in range(5)]
    rows += [(1, "lost", "gone", 0, None, None), (1, "x", "y", 0, None, None), (1, "y", "x", 0, None, None), (1, "self", "self", 0, None, None), (2, "f", "l1", 0, None, None)]
    rows += [(3, "end", None, 4, "pending", None)] + [(3, f"c{k}", f"c{k - 1}" if k else "end", 0, None, None) for k in range(40)]
    t = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "member_id int, archive_id int, path string, link_path string, raw_size long, raw_state string, raw_digest string")
    got = {(r.archive_id, r.path): (r.size, r.content_state, r.digest) for r in places.resolve_links(t).collect()}
    assert len(got) == len(rows)
    assert all(got[1, f"l{k}"] == (9, "hashed", "d") for k in range(5)) and got[1, "f"] == (9, "hashed", "d")
    assert all(got[k] == (0, None, None) for k in ((1, "lost"), (1, "x"), (1, "y"), (1, "self"), (2, "f")))
    assert all(got[3, f"c{k}"] == (4, "pending", None) for k in range(40))


def split_plainly(size, weights):
    """Largest remainders in whole numbers, then a byte for every place with members."""
    w, size = [max(x, 0) for x in weights], max(size, 0)
    total = sum(w)
    if not total:
        return [0] * len(w)
    shares, rest = [size * x // total for x in w], [size * x % total for x in w]
    for _ in range(size - sum(shares)):
        k = max((k for k in range(len(w)) if w[k]), key=lambda k: (rest[k], -k))
        shares[k], rest[k] = shares[k] + 1, 0
    for k in range(len(w)):
        top = max(shares)
        if w[k] and not shares[k] and top > 1:
            shares[shares.index(top)] -= 1
            shares[k] = 1
    return shares


def test_split_equals_whole_numbers(spark):
    import random

    rng = random.Random(4)
    rows = [(s, w) for s in (0, 1, 2, 10, -3) for w in ([1, 1, 1, 0, 0], [2**62, 2**62, 1, 0, 0], [0] * 5, [1, 10**9, 1, 1, 1], [-5, 3, 0, 0, 1])]
    rows += [(2**62, [2**62] * 5), (2**63 - 1, [2**63 - 1, 1, 2**63 - 1, 7, 3])]
    rows += [(rng.randrange(40), [rng.choice([0, 1, 3, 1000]) for _ in range(5)]) for _ in range(200)]
    t = spark.createDataFrame(rows, "size long, weights array<long>")
    for r in t.withColumn("shares", places.split_archive(F.col("size"), F.col("weights"))).collect():
        assert r.shares == split_plainly(r.size, r.weights), (r.size, r.weights)


def test_names_are_injective():
    raw = [b"a\\b", b"a\xffb", "a​b".encode(), b"a\\xFFb", b"plain"]
    assert len({shown(x) for x in raw}) == len(raw)


def test_requests_are_checked():
    for bad in (search.Query(order="odd"), search.Query(min_size=2, max_size=1), search.Query(name="")):
        with pytest.raises(ValueError):
            bad.predicate()
    assert search.decode_cursor(search.encode_cursor(5, 7)) == (5, 7)


def test_resolve_gives_all_or_refuses(spark, sf):
    large = sf.replace("sf0.001", "sf0.1")
    texts = spark.read.parquet(f"{large}/documents.parquet")
    got = [r.entry_id for r in registry.QUERIES["o12_resolve"](spark, large).collect()]
    want = sorted(r.doc_id for r in texts.where("n_chars > 5000").select("doc_id").collect())
    assert len(got) > 1001 and got == want
    few = spark.createDataFrame([(k, k) for k in range(20)], "entry_id long, size long")
    assert [r.entry_id for r in search.resolve(few, search.Query(min_size=10), 10).collect()] == list(range(10, 20))
    with pytest.raises(ValueError):
        search.resolve(few, search.Query(min_size=10), 9)


def test_wrapper_goes_where_paths_then_agree(spark):
    kind = "path string, key string"
    left = spark.createDataFrame([("a/1", "k"), ("b/2", "m")], kind)
    right = spark.createDataFrame([("w/a/1", "k"), ("w/b/2", "m")], kind)
    paths = lambda d: {r.path for r in d.collect()}
    l, r = relations.drop_wrapper(left, right)  # noqa: E741
    assert paths(l) == paths(r) == {"a/1", "b/2"}
    l, r = relations.drop_wrapper(right, right)  # noqa: E741
    assert paths(l) == paths(r) == {"w/a/1", "w/b/2"}
    l, r = relations.drop_wrapper(left, left.limit(0))  # noqa: E741
    assert paths(l) == {"a/1", "b/2"} and paths(r) == set()


def test_merge_makes_missing_folders_only(spark):
    here = spark.createDataFrame([("a/n/1",), ("a/2",), ("b/3",)], "path string")
    there = spark.createDataFrame([("a/2",), ("a/4",)], "path string")
    got = {(r.op, r.path, r.level) for r in changes.merge_draft(here, there).collect()}
    assert got == {("mkdir", "a/n", 2), ("mkdir", "b", 1), ("rename", "a/n/1", 3), ("conflict", "a/2", 2), ("rename", "b/3", 2)}


def test_restore_states(spark):
    items = spark.createDataFrame([(1, "a/x"), (2, "a/y"), (3, "a/y"), (4, "gone/z"), (5, "top")], "entry_id long, origin string")
    got = {r.entry_id: r.state for r in changes.restore_draft(items, spark.createDataFrame([("a/x",)], "path string")).collect()}
    assert got == {1: "taken", 2: "planned", 3: "taken_in_plan", 4: "no_folder", 5: "planned"}


def test_rescue_names_the_outermost_group(spark):
    ind = spark.createDataFrame([("g/h/i", 5), ("g/h/i/j", 2), ("out/k", 9)], "path string, bytes long")
    got = intent.rescue(ind, spark.createDataFrame([("g",), ("g/h",)], "path string")).collect()
    assert [tuple(r) for r in got] == [("g", "g/h/i", 5)]


def test_preview_finds_the_encoding():
    assert preview_text(b"\xef\xbb\xbfab", 9) == ("UTF-8", "ab")
    assert preview_text("aé".encode(), 2) == ("UTF-8", "a")
    assert preview_text(b"\xff\xfea\x00b\x00", 5) == ("UTF-16LE", "a")
    assert preview_text(b"\xfe\xff\x00a", 9) == ("UTF-16BE", "a")
    assert preview_text(b"caf\xe9 ", 9) == ("windows-1252", "café ")
    assert preview_text(b"", 9) == ("UTF-8", "")


def test_places_of_a_content(spark):
    """One content on two disks, one twice on a disk, one alone, one pending, one empty; a member makes another copy."""
    from granary.operators import places

    columns = "entry_id long, source_id string, digest string, size long, content_state string, state string, nlink int"
    rows = [
        (1, "p", "a", 5, "hashed", "present", 1), (2, "q", "a", 5, "hashed", "present", 1), (3, "p", "b", 6, "hashed", "present", 1), (4, "p", "b", 6, "hashed", "present", 1),
        (5, "p", "c", 7, "hashed", "present", 1), (6, "p", None, 8, "pending", "present", 1), (7, "p", None, 0, None, "present", 1), (8, "p", None, 9, "unique_size", "present", 1),
        (9, "p", None, 9, "sampled", "present", 1), (10, "p", "d", 3, "hashed", "present", 2), (11, "p", "d", 3, "hashed", "present", 2), (12, "p", "e", 4, "hashed", "missing", 1),
        (13, "p", None, 4, "unreadable", "present", 1), (14, "p", "z", 90, "hashed", "present", 1), (15, "q", "f", 2, "hashed", "present", 1),
    ]
    extra = {"path": "cast(entry_id as string)", "stable": "true", "online": "source_id = 'p'", "quarantined": "false", "dev": "1", "ino": "if(nlink > 1, 1, entry_id)"}
    files = spark.createDataFrame(rows, columns).selectExpr("*", *(f"{e} as {c}" for c, e in extra.items()))
    members = spark.createDataFrame([(1, 14, "in/x", None, 2, "hashed", "f")], "member_id long, archive_id long, path string, link_path string, size long, content_state string, digest string")
    listed = spark.createDataFrame([(14, "complete")], "archive_id long, listing string")
    inner = places.placed_members(members, listed, files)
    got = {r.entry_id: r for r in places.places(files, places.copies(files, inner)).collect()}
    want = {1: "other_source", 2: "other_source", 3: "this_source", 4: "this_source", 5: "only_copy", 6: "unchecked", 7: "none", 8: "only_copy", 9: "only_copy", 10: "only_copy", 11: "only_copy", 12: None, 13: "unreadable", 15: "other_source"}
    assert {k: got[k].place for k in want} == want
    assert got[1].offline_only and not got[2].offline_only
    assert [r.place for r in places.places(inner, places.copies(files, inner)).collect()] == ["other_source"]
    amounts = {p: 0 for q in (*places.ORDER, "disposable") for p in (f"{q}_files", f"{q}_bytes")}
    decide = lambda complete, **files_in: spark.createDataFrame([{**amounts, **files_in}]).select(places.folder_place(F.lit(complete))).first()[0]
    assert decide(True, only_copy_files=1, unreadable_files=9) == "only_copy" and decide(True, unchecked_files=1, unreadable_files=1) == "unchecked"
    assert decide(False, other_source_files=2) == "unreadable" and decide(True, other_source_files=2) == "other_source" and decide(False) == "unreadable"


def test_clock_offsets(spark):
    """A camera 26 h ahead at two events, another one with GPS; without GPS the same camera merely disagrees."""
    from granary.operators import dates

    hour = 3600 * dates.SECOND
    def shots(gps):
        rows = []
        for event in (0, 500):
            for k in range(5):
                rows.append((f"f{event}", "right", (event + k) * hour, (event + k) * hour if gps else None))
                rows.append((f"f{event}", "ahead", (event + 26 + k) * hour, None))
        return spark.createDataFrame(rows, "folder string, camera string, capture_ns long, gps_ns long").selectExpr("*", "false as offset_known", "cast(null as struct<ns:bigint,local:string,precision:string>) as folder_day")
    got = {r.camera: (r.state, r.shift_s) for r in dates.detect(shots(True)).collect()}
    assert got == {"ahead": ("offset", -26 * 3600), "right": ("ok", None)}
    assert {r.camera: r.state for r in dates.detect(shots(False)).collect()} == {"ahead": "disagrees", "right": "disagrees"}


def test_rule_packs_are_checked(spark):
    from granary.operators import rules

    pack = rules.load_pack('[[signal]]\nid = "s"\nnames = ["*.s"]\n[[file]]\nid = "a"\npriority = 5\ncategory = "cache"\nnames = ["*.c"]\n[[folder]]\nid = "b"\npriority = 1\nchild_any = ["s"]\ncategory = "backup"\n')
    files = spark.createDataFrame([("x.C", "other", 1), ("y", "other", 1)], "name string, file_kind string, size long")
    assert [(r.category, r.triage) for r in rules.classify_files(files, pack.files).orderBy("name").collect()] == [("cache", "discard"), ("unknown", "review")]
    for bad in ('[[folder]]\nid = "b"\npriority = 1\nchild_any = ["t"]', '[[file]]\nid = "a"\npriority = 1\ncategory = "odd"', '[[file]]\nid = "a"\npriority = 1\n[[file]]\nid = "a"\npriority = 2'):
        with pytest.raises(ValueError):
            rules.load_pack(bad)
