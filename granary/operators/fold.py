"""Folder totals and breakdowns from the bottom up.

Every entry is counted for each folder above it by exploding its path prefixes;
partial aggregation runs before the shuffle, so a folder that holds a large part
of the tree costs one row per task.  ``by`` names columns that tell volumes apart: equal
paths of two volumes are different folders, and each volume has its own root.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import depth, known_time, parent, with_ancestors
from granary.functions.runs import checkpoint, reduced, sizes


def totals(entries: DataFrame, root: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Per folder: ``files``, ``bytes``, ``oldest``, ``newest``."""
    return (
        with_ancestors(entries, root)
        .groupBy(*by, "ancestor", "level")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            F.min("mtime_s").alias("oldest"),
            F.max("mtime_s").alias("newest"),
        )
    )


def refold(stored: DataFrame, gone: DataFrame, come: DataFrame, entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``totals`` kept up with a change (T5, T10), without counting what did not change.

    ``stored`` is the fold before it, ``gone`` and ``come`` the old and the new rows
    of the entries that changed (an entry that only has another time is in both),
    ``entries`` the table after it.  Files and bytes move by signed sums.  An
    oldest or newest time is taken over or lowered from the new rows; only where a
    row that had it went is it looked up among the entries below.
    Folders without files are no more.
    """
    key = [*by, "ancestor", "level"]

    def spread(rows: DataFrame, sign: int) -> DataFrame:
        marked = rows.withColumns({"sign": F.lit(sign), "was": F.lit(sign < 0)})
        return with_ancestors(marked, True)

    ends = [f(F.when(F.col("was") == w, F.col("mtime_s"))).alias(n) for w, n, f in ((True, "gone_low", F.min), (True, "gone_high", F.max), (False, "come_low", F.min), (False, "come_high", F.max))]
    moved = spread(gone, -1).unionByName(spread(come, 1)).groupBy(*key).agg(F.sum("sign").alias("d_files"), F.sum(F.col("sign") * F.col("size")).alias("d_bytes"), *ends)
    joined = stored.join(moved, key, "full_outer")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    lost_low = F.coalesce(F.col("gone_low") <= F.col("oldest"), F.lit(False)) & ~F.coalesce(F.col("come_low") <= F.col("oldest"), F.lit(False))
    lost_high = F.coalesce(F.col("gone_high") >= F.col("newest"), F.lit(False)) & ~F.coalesce(F.col("come_high") >= F.col("newest"), F.lit(False))
    now = checkpoint(
        joined.select(
            *key,
            (none("files") + none("d_files")).alias("files"),
            (none("bytes") + none("d_bytes")).alias("bytes"),
            F.least("oldest", "come_low").alias("oldest"),
            F.greatest("newest", "come_high").alias("newest"),
            (lost_low | lost_high).alias("lost"),
        ).where("files > 0")
    )
    # Found for every folder before the join: joined first, all entries below the root would meet in one task.
    found = with_ancestors(entries, True).groupBy(*key).agg(F.min("mtime_s").alias("low"), F.max("mtime_s").alias("high"))
    mended = now.where("lost").drop("oldest", "newest").join(found, key, "left").withColumnsRenamed({"low": "oldest", "high": "newest"})
    return now.where("not lost").unionByName(mended.select(*now.columns)).drop("lost")


def breakdown(entries: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Per folder and value of ``key``: ``files``, ``bytes``."""
    return with_ancestors(entries, True).groupBy(*by, "ancestor", key).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("granary_place", F.row_number().over(place)).where("granary_place = 1").drop("granary_place")


def main_kind(entries: DataFrame, key: str = "kind", by: Sequence[str] = ()) -> DataFrame:
    """Per folder the kind with most bytes, then most files, then the smallest name."""
    return first_by(breakdown(entries, key, by), [*by, "ancestor"], F.desc("bytes"), F.desc("files"), F.asc(key))


def composition(entries: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per folder and family: bytes, where a grouped folder hides its inner mix from those above it.

    ``groups`` has ``group_path``, ``group_family`` and ``by``.  A file counts for a
    folder under the family of the highest group strictly below that folder, or
    under its own.  Sums go up level by level, so no folder gathers the rows of all
    files below it.
    """
    key = [*by, "ancestor"]
    files = entries.where(depth(F.col("path")) > 0).select(*by, parent(F.col("path")).alias("ancestor"), F.col("family").alias("shown"), F.col("size").alias("bytes"))
    own = checkpoint(files.groupBy(*key, "shown").agg(F.sum("bytes").alias("bytes")).withColumn("level", depth(F.col("ancestor"))))
    named = groups.where("group_family is not null").select(*by, F.col("group_path").alias("ancestor"), "group_family")
    deepest = own.agg(F.max("level")).first()[0] or 0
    columns = [*key, "shown", "bytes"]
    out = done = own.where(F.col("level") == deepest).select(*columns)
    for level in range(deepest, 0, -1):
        below = done.join(named, key, "left").select(*by, parent(F.col("ancestor")).alias("ancestor"), F.coalesce("group_family", "shown").alias("shown"), "bytes")
        here = own.where(F.col("level") == level - 1).select(*columns)
        done = checkpoint(here.unionByName(below).groupBy(*key, "shown").agg(F.sum("bytes").alias("bytes")))
        out = out.unionByName(done)
    return out


def top_per_folder(entries: DataFrame, most: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` rows below each folder with their ``rank``, in a total order."""
    return with_ancestors(entries, True).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "ancestor").orderBy(*order))).where(F.col("rank") <= most)


def notable(entries: DataFrame, groups: DataFrame, families: Sequence[str], most: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """What stands out in each folder (A7): at most ``most`` files and folders of other families than its main one.

    ``entries``: path, size, family; ``groups``: path of folders that stand for
    themselves.  For each family that may be the main one of the folder above, a
    folder stands out itself where it is a group or holds less than half of its
    bytes in that family; else what stands out inside it does.  Levels are gone
    through once from the deepest up, with lists of bounded length per folder and
    family, larger first, then by path; so no folder is joined with all that lies
    below it; sums and lists are made in tasks of about ``runs.TASK_ROWS`` rows.
    The main family has most bytes, ties by the order of ``families``.

    Returns ``by``, ``folder``, ``path``, ``bytes``, ``is_folder`` and ``rank``; a
    folder without bytes has no main family and lists nothing.
    """
    key = [*by, "folder"]
    shares = [f"b{k}" for k in range(len(families))]
    own = entries.select(*by, parent(F.col("path")).alias("folder"), "path", F.col("size").alias("bytes"), "family").where("folder is not null")
    direct = sizes(own, key)

    def added(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("files", "bytes", *shares)), F.max("is_group").alias("is_group"))

    # groups are added up with the files, as folders that have none
    of_family = [F.when(F.col("family") == f, F.col("bytes")).otherwise(0).alias(b) for f, b in zip(families, shares)]
    files = own.select(*key, "path", F.lit(1).alias("files"), "bytes", *of_family, F.lit(False).alias("is_group"))
    none = [F.lit(None).alias(c) for c in ("bytes", *shares)]
    marked = groups.where("path is not null").select(*by, F.col("path").alias("folder"), "path", F.lit(0).alias("files"), *none, F.lit(True).alias("is_group"))
    per = checkpoint(reduced(files.unionByName(marked), key, "path", added, direct).withColumn("level", depth(F.col("folder"))))
    folders, deepest = per.agg(F.count(F.lit(1)), F.max(F.when(F.col("files") > 0, F.col("level")))).first()
    deepest = deepest or 0
    sums = {deepest: per.where(F.col("level") == deepest)}
    for level in range(deepest, 0, -1):
        below = sums[level].where("files > 0").select(*by, parent(F.col("folder")).alias("folder"), F.col("folder").alias("path"), "files", "bytes", *shares, F.lit(False).alias("is_group"))
        here = per.where(F.col("level") == level - 1).select(*key, F.lit("").alias("path"), "files", "bytes", *shares, "is_group")
        sums[level - 1] = checkpoint(reduced(here.unionByName(below), key, "path", added, bound=folders))

    best = F.greatest(*shares) if len(families) > 1 else F.col("b0")
    main = F.when(F.col("bytes") > 0, F.coalesce(*(F.when(F.col(b) == best, F.lit(k)) for k, b in enumerate(shares))))
    itself = F.array(*(F.col("is_group") | (2 * F.col(b) < F.col("bytes")) for b in shares))
    marks = {level: s.where("files > 0").select(*key, F.col("bytes").alias("all_bytes"), itself.alias("itself"), main.alias("main")) for level, s in sums.items()}
    columns = [*key, "against", "path", "bytes", "is_folder"]

    def shortest(rows: DataFrame, key: list[str]) -> DataFrame:
        ranks = Window.partitionBy(*key, "against").orderBy(F.desc("bytes"), "path")
        return rows.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= most)

    def judged(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Whether a list goes ``up``, as its folder does not stand out itself, and whether it is ``shown``, as that against the main family."""
        stands = F.element_at("itself", F.col("against") + 1)
        return rows.join(of, key).select(*columns, "rank", (~stands).alias("up"), (F.col("main") == F.col("against")).alias("shown"))

    against = F.explode(F.array(*(F.lit(k) for k in range(len(families))))).alias("against")
    odd = own.select("*", against).where(F.element_at(F.array(*(F.lit(f) for f in families)), F.col("against") + 1) != F.col("family"))
    odd = odd.select(*key, "against", "path", "bytes", F.lit(False).alias("is_folder"))
    lists = judged(reduced(odd, key, "path", shortest, direct), functools.reduce(DataFrame.unionByName, marks.values()))
    lists = checkpoint(lists.withColumn("level", depth(F.col("folder"))))
    most_rows = lists.count() + folders * len(families)
    done = lists.where(F.col("level") == deepest).drop("level")
    out = [done]
    for level in range(deepest, 0, -1):
        up = [*by, parent(F.col("folder")).alias("folder")]
        whole = marks[level].select(*up, F.col("folder").alias("path"), F.col("all_bytes").alias("bytes"), F.lit(True).alias("is_folder"), "itself", against).where(F.element_at("itself", F.col("against") + 1))
        inner = done.where("up").select(*up, "against", "path", "bytes", "is_folder")
        files = lists.where(F.col("level") == level - 1).select(*columns)
        met = files.unionByName(whole.select(*columns)).unionByName(inner)
        done = checkpoint(judged(reduced(met, key, "path", shortest, bound=most_rows), marks[level - 1]))
        out.append(done)
    # a list's ranks are those among what is shown, as it is one against one family
    return functools.reduce(DataFrame.unionByName, out).where("shown").select(*key, "path", "bytes", "is_folder", "rank")


def figures(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All figures of each folder (A1): ``folders``, ``symlinks``, ``specials``, ``unreadable``, ``mounts``, ``partial``, ``files``, ``bytes``, ``oldest``, ``newest``.

    ``entries``: path, kind (file, directory, symlink, other), state, mount (a
    folder that begins another volume), partial (a folder read in part), size and
    mtime_ns.  Times before ``FIRST_KNOWN_NS`` are unknown.  Every folder has a
    row, empty ones too.
    """
    kind, size = F.col("kind"), F.when(F.col("kind") == "file", F.col("size")).otherwise(0)
    shut = (kind == "directory") & (F.col("partial") | (F.col("state") == "unreadable"))
    marks = {
        "folders": F.count_if(kind == "directory"),
        "symlinks": F.count_if(kind == "symlink"),
        "specials": F.count_if(kind == "other"),
        "unreadable": F.count_if(F.col("state") == "unreadable"),
        "mounts": F.count_if(F.col("mount")),
        "partial": F.bool_or(shut),
        "files": F.count_if(kind == "file"),
        "bytes": F.sum(size),
        "oldest": F.min(F.when(kind == "file", known_time(F.col("mtime_ns")))),
        "newest": F.max(F.when(kind == "file", known_time(F.col("mtime_ns")))),
    }
    # a folder's own mark of being read in part is its own figure as well as that of those above
    folder = [*by, "ancestor"]
    own = entries.where(kind == "directory").select(*by, F.col("path").alias("ancestor"), F.coalesce(shut, F.lit(False)).alias("own_partial"))
    below = with_ancestors(entries, True).groupBy(*folder).agg(*(c.alias(n) for n, c in marks.items()))
    joined = below.join(own.where("ancestor <> ''"), folder, "full_outer")
    counts = [n for n in marks if n not in ("partial", "oldest", "newest")]
    return joined.select(
        *folder, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts), F.coalesce(F.col("partial") | F.col("own_partial"), "partial", "own_partial", F.lit(False)).alias("partial"), "oldest", "newest"
    )
