"""Path algebra on columns: parents, depth, names, extensions, ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times before the second day of 1970 (UTC, nanoseconds) are unknown.
FIRST_KNOWN_NS = 86_400_000_000_000


def depth(path: Column) -> Column:
    """Number of components; the root (empty path) has none."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/", -1)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(file_name: Column) -> Column:
    """Letters after the last dot, A-Z lower-cased; none where only the leading dot is."""
    return F.translate(F.regexp_extract(file_name, r"^.+\.([^.]+)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def known_time(ns: Column) -> Column:
    return F.when(ns >= FIRST_KNOWN_NS, ns)


def below(path: Column, folder: str) -> Column:
    """Strict descendants of a folder; of the root, every non-empty path."""
    return path != "" if folder == "" else path.startswith(folder + "/")


def with_ancestors(entries: DataFrame, root: bool = False, column: str = "ancestor") -> DataFrame:
    """One row per entry and folder above it (``ancestor``, ``level``); the root, level 0, if asked.

    The equi-join key of everything below a folder: range predicates on paths
    become hash joins and grouped aggregations.
    """
    levels = F.sequence(F.lit(0 if root else 1), depth(F.col("path")) - 1)
    has = depth(F.col("path")) > (0 if root else 1)
    return (
        entries.where(has)
        .withColumn("level", F.explode(levels))
        .withColumn(column, F.when(F.col("level") == 0, "").otherwise(F.expr("substring_index(path, '/', level)")))
    )


#: A folder is crowded that lies above more rows than this, and above more than one in 2^14 of all pairs of a row and a folder.
CROWDED, CROWDED_SHARE = 1 << 12, 1 << 14


def above(entries: DataFrame, folders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``with_ancestors`` with the root, of ``folders`` (``by``, ``ancestor``, each once) only.

    By folder, all rows below the root or another large folder would meet in one
    task.  Such crowded folders are told by counts, which are added up before the
    shuffle; they are few (each has more than one in 2^14 of all pairs), so those
    among ``folders`` are broadcast, and the others meet by folder.
    """
    key = [*by, "ancestor"]
    spots = with_ancestors(entries, True)
    counts = spots.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    crowded = counts.join(F.broadcast(spots.agg(F.count(F.lit(1)).alias("total")))).where(F.col("n") * CROWDED_SHARE > F.col("total")).select(*key)
    among = F.broadcast(crowded.join(folders, key, "left_semi"))
    return spots.join(among, key, "left_semi").unionByName(spots.join(F.broadcast(crowded), key, "left_anti").join(folders.select(*key), key, "left_semi"))


def folded(text: Column) -> Column:
    """Lower case without accents, for names in Latin script."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, "ß", "ss")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` any run, ``?`` one character, letters of either case."""
    import re

    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"(?is)^{body}$"
