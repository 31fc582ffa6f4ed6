"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups.

Rows of a group are leaves in ascending (id, leaf) order.  While a level has more
than one node, every FAN consecutive nodes become their hash; what remains is the
group's subroot, and the subroots in group order (null first, bytewise) give the
root the same way.

Leaves are numbered by range-wise running sums and dealt into blocks of FAN^DEPTH
consecutive leaves, so a group of any size is many blocks and a block is an array
of bounded length.  Inside a block, sequence, slice, transform and aggregate
collapse up to DEPTH levels; block roots are the leaves of the next round.  On
the way back each block hands its node's path (the hashes left and right of it,
level by level) down to its members.  DataFrame and SQL functions only.

Null and repeated ids are leaves like any other (null ids first; of equal ids
the smaller leaf first, and equal leaves are alike).  A group of one leaf is
that leaf.  An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, prefix_sums

FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values laid end to end: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _steps(n: str) -> Column:
    """Levels that a block of a group of ``n`` nodes collapses: until one node is left, DEPTH at most."""
    out = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        out = F.when(F.col(n) <= FAN**k, k).otherwise(out)
    return out


def _parents(level: Column) -> Column:
    """Hashes of every FAN consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), ""), 256))


def _levels(nodes: Column, steps: Column) -> Column:
    """The block's nodes and their ``steps`` levels above."""
    grown = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.array(nodes).cast("array<array<string>>"),
        lambda levels, k: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
    )
    return F.when(steps > 0, grown).otherwise(F.array(nodes))


def _path(levels: Column, steps: Column, place: Column) -> Column:
    """What stands left and right of the ``place``-th node (from 0) and of its ancestors in their runs."""

    def beside(k: Column) -> Column:
        level, own = F.element_at(levels, k + 1), F.call_function("shiftright", place, k * 4)
        inside = F.pmod(own, F.lit(FAN))
        return F.struct(
            F.array_join(F.slice(level, own - inside + 1, inside), "").alias("before"),
            F.array_join(F.slice(level, own + 2, FAN - 1 - inside), "").alias("after"),
        )

    above = F.filter(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda k: k < steps)
    return F.transform(above, beside)


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Blocks of consecutive nodes with the levels inside; ``nodes`` has tree, place, n, hash and ``carry``."""
    members = F.array_sort(F.collect_list(F.struct("place", "hash", *carry)))
    return checkpoint(
        nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block"))
        .agg(members.alias("members"), F.first("n").alias("n"))
        .withColumn("steps", _steps("n"))
        .withColumn("levels", _levels(F.transform("members", lambda m: m["hash"]), F.col("steps")))
    )


def _next(blocks: DataFrame) -> DataFrame:
    """Block roots as the nodes of the next round."""
    top = F.element_at("levels", -1)[0]
    left = F.ceil(F.col("n") / F.pow(F.lit(FAN), F.col("steps")))
    return blocks.select("tree", F.col("block").alias("place"), left.cast("long").alias("n"), top.alias("hash"))


def _rounds(nodes: DataFrame, most: int, carry: Sequence[str] = ()) -> list[DataFrame]:
    """Tables of blocks from the leaves up, until every tree of at most ``most`` nodes is one node."""
    out = [_blocks(nodes, carry)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        out.append(_blocks(_next(out[-1]), ()))
    return out


def _down(rounds: list[DataFrame], path: DataFrame, carry: Sequence[str], above: Sequence[str]) -> DataFrame:
    """Every node with its path; ``path`` has tree, path and the columns ``above`` of each tree's top."""
    found = path.withColumn("place", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(rounds))):
        here = carry if k == 0 else ()
        joined = blocks.join(found.withColumnRenamed("place", "block"), ["tree", "block"])
        walked = F.transform(
            "members",
            lambda m, i: F.struct(
                m["place"].alias("place"),
                m["hash"].alias("hash"),
                *(m[c].alias(c) for c in here),  # noqa: B023
                F.concat(_path(F.col("levels"), F.col("steps"), i), F.col("path")).alias("path"),
            ),
        )
        found = joined.select("tree", *above, F.inline(walked))
        if k:
            found = checkpoint(found.drop("hash"))
    return found


def manifest(leaves: DataFrame, group_col: str, id_col: str, leaf_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each leaf with ``subroot``, ``root`` and ``path``: array of (before, after), from the leaf to the root.

    ``group_col`` is text or cast to it.  Returns id, leaf and the columns ``carry`` besides.
    """
    kept = [f"carried_{k}" for k in range(len(carry))]
    # '' is the null group, so that it comes first and joins like any other
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = checkpoint(
        leaves.select(
            group.alias("tree"), F.col(id_col).alias("leaf_id"), F.col(leaf_col).alias("hash"), *(F.col(c).alias(x) for c, x in zip(carry, kept, strict=True))
        )
    )
    trees = checkpoint(prefix_sums(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), ["tree"], "n"))
    most, n_trees = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    # a tree is a run of the numbering, so it meets its leaves stretch by stretch and none is hot
    stretch = F.explode(F.sequence(F.floor(F.col("n_before") / BLOCK), F.floor((F.col("n_before") + F.col("n") - 1) / BLOCK)))
    runs = trees.select("tree", "n", "n_before", stretch.alias("stretch"))
    numbered = prefix_sums(rows, ["tree", "leaf_id", "hash"]).withColumn("stretch", F.floor(F.col("row_index") / BLOCK)).join(runs, ["tree", "stretch"])
    nodes = numbered.withColumn("place", F.col("row_index") - F.col("n_before"))
    below = _rounds(nodes, most or 0, ["leaf_id", *kept])
    tops = _next(below[-1]).select("tree", "hash")
    subroots = tops.join(trees.select("tree", F.col("row_index").alias("place")), "tree")
    upper = _rounds(
        subroots.select(F.lit("all").alias("tree"), "place", F.lit(n_trees).cast("long").alias("n"), "hash", F.col("tree").alias("below")), n_trees, ["below"]
    )
    root = _next(upper[-1]).select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    trees_found = checkpoint(
        _down(upper, root, ["below"], ["root"]).select(F.col("below").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    )
    found = _down(below, trees_found, ["leaf_id", *kept], ["subroot", "root"])
    return found.select(
        F.col("leaf_id").alias(id_col), F.col("hash").alias(leaf_col), *(F.col(x).alias(c) for c, x in zip(carry, kept, strict=True)), "subroot", "root", "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All hashes of a path, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def verify(docs: DataFrame, columns: Sequence[str], group_col: str, id_col: str, tampered: dict[str, Column], where: Column) -> DataFrame:
    """The manifest of ``docs`` (a leaf is the digest of ``columns``) held against rows changed afterwards.

    ``tampered`` replaces columns of the rows that ``where`` names (null: not).
    Returns id, ``leaf``, ``subroot``, ``root``, ``path``, ``folded_root`` and ``verified``.
    """
    changed = F.when(where, digest(*(tampered.get(c, F.col(c)) for c in columns)))
    leaves = docs.select(
        F.col(group_col).alias("group_of"), F.col(id_col).alias("id_of"), digest(*(F.col(c) for c in columns)).alias("leaf"), changed.alias("changed")
    )
    found = manifest(leaves, "group_of", "id_of", "leaf", ["changed"])
    return found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path"))).select(
        F.col("id_of").alias(id_col), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
