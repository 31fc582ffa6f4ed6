"""Changes between snapshots, and drafts of moves and clean-ups.

``by`` names columns that tell volumes apart, in all tables of a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import depth, parent, with_ancestors
from granary.functions.runs import numbered, spread


def same_time(a: Column, b: Column, resolution: int, local_time: bool) -> Column:
    """Equal within the file system's resolution, or, where it keeps local time, an hour apart within it."""
    d = F.abs(a - b)
    out = d <= resolution
    return out | (F.abs(d - 3_600_000_000_000) <= resolution) if local_time else out


def snapshot_diff(old: DataFrame, new: DataFrame, resolution: int = 0, local_time: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``op`` for each path of either listing (``path``, ``kind``, ``size``, ``mtime_ns``)."""
    o = old.select(*by, "path", F.col("kind").alias("old_kind"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_ns"))
    j = o.join(new.select(*by, "path", "kind", "size", "mtime_ns"), [*by, "path"], "full_outer")
    same = (F.col("size") == F.col("old_size")) & same_time(F.col("mtime_ns"), F.col("old_ns"), resolution, local_time)
    return j.select(
        *by,
        "path",
        F.when(F.col("old_kind").isNull(), "insert")
        .when(F.col("kind").isNull(), "missing")
        .when(F.col("kind") != F.col("old_kind"), "replace")
        .when(same, "unchanged")
        .otherwise("update")
        .alias("op"),
    )


def name_conflicts(moves: DataFrame, fold_case: bool) -> DataFrame:
    """``conflict`` of planned moves (``seq``, ``dest``, ``name``): a later item of the plan takes a name that an earlier one has."""
    key = F.lower("name") if fold_case else F.col("name")
    order = Window.partitionBy("dest", key).orderBy("seq")
    return moves.withColumn("conflict", F.row_number().over(order) > 1)


def last_copies(discards: DataFrame, copy: DataFrame) -> DataFrame:
    """Refusal of discards that would take a content's last copy (X10): ``entry_id``, ``refused``.

    ``discards``: entry_id, source_id, path, of whole files.  ``copy`` is the
    relation of readable copies (``places.copies``), with members of archives; a
    member goes with its archive.  In path order every discard is allowed while
    another name of the content stays, so only the last one can be refused, where
    none does: three figures per content, and no group is ordered.  Entries that
    are no readable copy take nothing and are allowed.
    """
    gone = discards.select(F.col("entry_id").alias("holder"), F.lit(True).alias("goes"))
    names = copy.join(gone, "holder", "left").withColumn("goes", F.coalesce("goes", F.lit(False)))
    own = ~F.col("member") & F.col("goes")
    last = F.max(F.when(own, F.struct("at_path", "source_id", "id")))
    per = names.groupBy("digest").agg(F.bool_and("goes").alias("all_go"), last.alias("last")).where("all_go and last is not null")
    refused = per.select(F.col("last.id").alias("entry_id"), F.lit(True).alias("refused"))
    return discards.select("entry_id").join(refused, "entry_id", "left").select("entry_id", F.coalesce("refused", F.lit(False)).alias("refused"))


def overlapping_roots(roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roots (``path``) that lie below another root of their volume (S17): ``outer_path``, ``inner_path``."""
    known = roots.select(*by, "path").distinct()
    outer = known.withColumnRenamed("path", "outer_path").withColumn("ancestor", F.col("outer_path"))
    return with_ancestors(known).join(outer, [*by, "ancestor"]).select(*by, "outer_path", F.col("path").alias("inner_path"))


#: The folder of a volume that holds what was set aside.
QUARANTINE = ".quarantine"


def refusal(bulk: bool = False, move_out: bool = False) -> Column:
    """Why an entry cannot move, whatever names are there; null where it can (X1).  The first reason that holds counts.

    Over the columns source_id, path, kind, state, mount (begins another volume),
    mounts (such folders below it), decision (its own, or null) and effective of
    the entry; plan_source, dest (a folder's path), dest_effective and name of the
    move.  In bulk, nothing kept moves to where it would not be.
    """
    path, dest = F.col("path"), F.col("dest")
    set_aside = lambda c: (c == QUARANTINE) | c.startswith(QUARANTINE + "/")
    folder = F.col("kind") == "directory"
    into_itself = folder & ((dest == path) | F.startswith(dest, F.concat(path, F.lit("/"))))
    there = (dest == parent(path)) & (F.col("name") == F.substring_index(path, "/", -1))
    loses = F.lit(bulk) & (F.col("effective") == "keep") & F.col("decision").isNull() & (F.col("dest_effective") != F.col("effective"))
    return (
        F.when(F.col("source_id") != F.col("plan_source"), "other_source")
        .when(set_aside(path) & (F.lit(not move_out) | set_aside(dest)), "in_quarantine")
        .when(F.col("state") == "missing", "missing")
        .when(path == "", "source_root")
        .when(F.col("mount"), "other_filesystem")
        .when(folder & (F.col("mounts") > 0), "contains_mount")
        .when(into_itself, "into_itself")
        .when(there, "already_there")
        .when((dest == "") & (F.col("name") == QUARANTINE), "reserved_name")
        .when(loses, "would_lose_keep")
    )


def siblings_left(moves: DataFrame, files: DataFrame, fold_case: bool = True) -> DataFrame:
    """Moves that leave files of the same stem behind (X20): ``entry_id`` and ``left``, their number.

    ``moves``: entry_id, folder, name, dest; ``files``: folder, name of all that is
    there.  Files of one stem that go to the same place stay together.  Figures per
    folder and stem, and per destination, tell; files are not paired.
    """
    stem = F.regexp_replace("name", r"(.)\.[^.]*$", "$1")
    key = F.lower(stem) if fold_case else stem
    total = files.withColumn("stem", key).groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("total"))
    marked = moves.withColumn("stem", key)
    together = marked.groupBy("folder", "stem", "dest").agg(F.count(F.lit(1)).alias("together"))
    at = marked.join(total, ["folder", "stem"]).join(together, ["folder", "stem", "dest"])
    return at.select("entry_id", (F.col("total") - F.col("together")).alias("left")).where(F.col("left") > 0)


def drop_unused_folders(items: DataFrame) -> DataFrame:
    """A plan without the folders that nothing moves into (X21), numbered anew: ``seq`` from 1, ``was`` before.

    ``items``: seq, op (mkdir, rename), path (where it is made or moved to) and
    state.  A folder is needed by the planned moves at any depth below it.
    """
    needed = with_ancestors(items.where("op = 'rename' and state = 'planned'").select("path")).select(F.col("ancestor").alias("path"), F.lit("mkdir").alias("op")).distinct()
    kept = items.where("op <> 'mkdir'").unionByName(items.where("op = 'mkdir'").join(needed, ["path", "op"], "left_semi").select(*items.columns))
    return numbered(kept, [], ["seq"], "place").withColumnRenamed("seq", "was").withColumnRenamed("place", "seq")


#: Highest number put behind a name, and bytes that a name can have.
MOST_SUFFIX, MOST_NAME_BYTES = 999, 255


def free_names(moves: DataFrame, present: DataFrame) -> DataFrame:
    """The names that moved files get (X5): ``entry_id``, ``free_name`` and ``reason``.

    ``moves``: entry_id, seq (their order), dest (a folder), name, digest or null;
    ``present``: dest, name, digest or null of what is there.  A name that nothing
    there and no earlier move has is kept.  One held by a file of the same content
    is refused (identical_copy).  The others get ``stem (k).ext`` with the first
    numbers k that are free: the k-th file of a name takes the k-th number that
    neither what is there nor any move's own name uses, so names that the plan
    makes never meet.  Numbers beyond MOST_SUFFIX or names beyond MOST_NAME_BYTES
    are refused (name_taken).
    """
    here = present.groupBy("dest", "name").agg(F.max("digest").alias("there_digest"), F.lit(True).alias("there"))
    order = Window.partitionBy("dest", "name").orderBy("seq")
    at = moves.withColumns({"turn": F.row_number().over(order), "first_digest": F.first("digest").over(order)}).join(here, ["dest", "name"], "left")
    keeps = F.col("there").isNull() & (F.col("turn") == 1)
    holder = F.when(F.col("there"), F.col("there_digest")).otherwise(F.col("first_digest"))
    at = at.withColumns({"keeps": keeps, "copied": ~keeps & F.coalesce(F.col("digest") == holder, F.lit(False))})
    has_ext = F.col("name").rlike(r"^.+\.[^.]*$")
    stem = F.when(has_ext, F.regexp_extract("name", r"^(.+)(\.[^.]*)$", 1)).otherwise(F.col("name"))
    ext = F.when(has_ext, F.regexp_extract("name", r"^(.+)(\.[^.]*)$", 2)).otherwise(F.lit(""))
    parts = {"stem": stem, "ext": ext}
    # numbers in use, of names there and of the moves' own
    used = present.select("dest", "name").unionByName(moves.select("dest", "name")).distinct().withColumns(parts)
    number = F.regexp_extract("stem", r"^(.+) \(([1-9][0-9]{0,2})\)$", 2)
    used = used.select("dest", F.regexp_extract("stem", r"^(.+) \(([1-9][0-9]{0,2})\)$", 1).alias("stem"), "ext", number.alias("number")).where("number <> ''").select("dest", "stem", "ext", F.col("number").cast("int").alias("number"))
    family = ["dest", "stem", "ext"]
    free_below = F.col("number") - F.row_number().over(Window.partitionBy(*family).orderBy("number"))
    taken = used.select(*family, (2 * free_below + 1).alias("mark"), F.lit(None).cast("long").alias("entry_id"), F.lit(1).alias("skip"))
    seek = at.where("not keeps and not copied").withColumns(parts)
    seek = seek.withColumn("nth", F.row_number().over(Window.partitionBy(*family).orderBy("seq")))
    asked = seek.select(*family, (2 * F.col("nth")).alias("mark"), F.col("entry_id").cast("long").alias("entry_id"), F.lit(0).alias("skip"))
    passed = F.sum("skip").over(Window.partitionBy(*family).orderBy("mark").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = taken.unionByName(asked).withColumn("k", passed + F.expr("mark div 2")).where("entry_id is not null")
    name = F.concat("stem", F.lit(" ("), F.col("k").cast("string"), F.lit(")"), "ext")
    fits = (F.col("k") <= MOST_SUFFIX) & (F.octet_length(name) <= MOST_NAME_BYTES)
    numbered = found.select("entry_id", F.when(fits, name).alias("numbered"))
    return at.join(numbered, "entry_id", "left").select(
        "entry_id",
        F.when(F.col("keeps"), F.col("name")).otherwise(F.col("numbered")).alias("free_name"),
        F.when(F.col("copied"), "identical_copy").when(~F.col("keeps") & F.col("numbered").isNull(), "name_taken").alias("reason"),
    )


def next_runs(schedules: DataFrame) -> DataFrame:
    """``next_at``: the first time of each schedule strictly after ``after`` (T8), both wall times of UTC.

    ``schedules``: after, zone, hour, minute, weekday (1 Monday to 7 Sunday,
    null: every day).  Days are the zone's.  A time of day that a change to summer
    time skips runs as much later as the clock jumps; one that occurs twice runs
    at its first occurrence.
    """
    day, weekday = F.col("granary_day"), F.col("weekday")
    first = F.pmod(weekday - 1 - F.weekday(day), F.lit(7)).cast("int")
    # Of the days from today on those that can be the first: a run later today may be over.
    days = F.when(weekday.isNull(), F.array(*map(F.lit, range(3)))).otherwise(F.array(first, first + 7))
    at = lambda n: F.date_add(day, n).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"), F.col("minute"))
    times = F.transform(days, lambda n: F.convert_timezone(F.col("zone"), F.lit("UTC"), at(n)))
    here = spread(schedules).withColumn("granary_day", F.to_date(F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("after"))))
    return here.withColumn("next_at", F.array_min(F.filter(times, lambda t: t > F.col("after")))).drop("granary_day")


def merge_draft(only_here: DataFrame, there: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moves of files (``path``) that only one side has to the same path of the other, and the folders to make first.

    ``op`` is mkdir, rename or conflict (the path is taken there); ``level`` is
    the depth, by which folders are made from the top.
    """
    key = [*by, "path"]
    taken = there.select(*key).distinct()
    at = only_here.select(*key).distinct().join(taken.withColumn("taken", F.lit(True)), key, "left")
    moves = at.select(*by, F.when(F.col("taken"), "conflict").otherwise("rename").alias("op"), "path", depth(F.col("path")).alias("level"))
    folders = lambda d: with_ancestors(d.select(*key)).select(*by, F.col("ancestor").alias("path"), "level").distinct()
    new = folders(moves.where("op = 'rename'")).join(folders(taken).select(*key), key, "left_anti")
    return new.select(*by, F.lit("mkdir").alias("op"), "path", "level").unionByName(moves)


def restore_draft(items: DataFrame, present: DataFrame, fold_case: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Where items (``entry_id``, ``origin``) can go back: ``state`` planned, no_folder, taken or taken_in_plan.

    ``present`` has the ``path`` of every entry that is there.  Of items that
    go to one name the first in path order, then by id, has it.
    """
    key = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    folders = with_ancestors(present.select(*by, "path")).select(*by, F.col("ancestor").alias("folder")).distinct()
    names = present.select(*by, key(F.col("path")).alias("name_key")).distinct().withColumn("taken", F.lit(True))
    at = items.withColumns({"folder": parent(F.col("origin")), "name_key": key(F.col("origin"))})
    known = at.join(folders.withColumn("there", F.lit(True)), [*by, "folder"], "left").join(names, [*by, "name_key"], "left")
    order = Window.partitionBy(*by, "name_key").orderBy("origin", "entry_id")
    state = (
        F.when(F.col("there").isNull() & (F.col("folder") != ""), "no_folder")
        .when(F.col("taken"), "taken")
        .when(F.row_number().over(order) > 1, "taken_in_plan")
        .otherwise("planned")
    )
    return known.select(*by, "entry_id", "origin", state.alias("state"))
