"""Decisions and tags: what an entry has itself and what it takes from above.

``by`` names columns that tell volumes apart, in all tables of a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.paths import above, depth, with_ancestors
from granary.functions.runs import checkpoint


def effective_decisions(entries: DataFrame, own: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The nearest decision at or above each entry (``decision``, ``origin``); undecided without any.

    ``own`` has ``own_path`` and ``own_decision``.  The decided paths are joined
    to the path prefixes of the entries; nothing is compared by range.
    """
    near = (
        _spots(entries, by)
        .join(own.withColumn("at", F.col("own_path")), [*by, "at"])
        .groupBy(*by, "path")
        .agg(F.max_by(F.struct("own_decision", "own_path"), "level").alias("n"))
    )
    return entries.join(near, [*by, "path"], "left").select(
        *entries.columns, F.coalesce("n.own_decision", F.lit("undecided")).alias("decision"), F.col("n.own_path").alias("origin")
    )


def _spots(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every entry's path with itself and each folder above it (``at``, ``level``)."""
    above = with_ancestors(entries.select(*by, "path"), True).select(*by, "path", F.col("ancestor").alias("at"), "level")
    return above.unionByName(entries.select(*by, "path", F.col("path").alias("at"), depth(F.col("path")).alias("level")))


def effective_tags(entries: DataFrame, own: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tags of each entry, its own and those of the folders above: ``path``, ``tag`` and ``level``, the depth of the nearest carrier.

    ``own`` has ``own_path`` and ``tag``.
    """
    return _spots(entries, by).join(own.withColumn("at", F.col("own_path")), [*by, "at"]).groupBy(*by, "path", "tag").agg(F.max("level").alias("level"))


def topmost(paths: DataFrame, column: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Paths of a set that have no other path of the set above them."""
    p = paths.select(*by, F.col(column).alias("path")).distinct()
    covered = above(p, p.withColumnRenamed("path", "ancestor"), by).select(*by, "path").distinct()
    return p.join(covered, [*by, "path"], "left_anti").withColumnRenamed("path", column)


def rescue(indicators: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Valuable entries (``path``, ``bytes``) inside disposable groups (``path``), each under its outermost group.

    An indicator inside another one is no row, so no byte counts twice.
    """
    g = groups.select(*by, F.col("path").alias("ancestor")).distinct()
    inside = checkpoint(above(indicators, g, by).groupBy(*by, "path", "bytes").agg(F.min_by("ancestor", "level").alias("group_path")))
    return inside.join(topmost(inside, by=by), [*by, "path"], "left_semi").select(*by, "group_path", "path", "bytes")
