"""Folder folds, breakdowns, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.paths import with_ancestors
from granary.operators import dates, fold
from granary.plans.registry import query
from granary.sources import adapters as a
from granary.sources import inventory as inv

_O = a.with_tables(a.TREE_ORDERS)
_OC = a.with_tables(a.TREE_ORDERS, a.closure_sql("tree_orders", True))


@query(
    "a1_folder_fold",
    _OC + " SELECT ancestor, level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(mtime_s) AS oldest, max(mtime_s) AS newest FROM closure GROUP BY ALL",
)
def a1(spark, sf):
    return fold.totals(a.tree_orders(spark, sf))


#: Files of the inventory with their folders, links and special files; a few folders are shut, read in part or another volume.
_ENTRIES = """entries AS (SELECT source_id, path, CASE WHEN entry_id % 23 = 7 THEN 'symlink' WHEN entry_id % 59 = 9 THEN 'other' ELSE 'file' END AS kind, state, false AS mount, false AS partial, size, mtime_ns FROM files
  UNION ALL SELECT DISTINCT source_id, array_to_string(string_split(path, '/')[: k], '/'), 'directory', CASE WHEN k = 2 AND ascii(path[-1]) % 5 = 1 AND path LIKE 'en/7/%' THEN 'unreadable' ELSE 'present' END,
    k = 2 AND path LIKE 'fr/3/%', k = 1 AND path LIKE 'es/%' AND source_id LIKE '%3', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT source_id, regexp_replace(path, '/[^/]*$', '/1') AS path FROM files), range(1, 3) t(k) WHERE k < len(string_split(path, '/')))"""


def entries(spark, sf):
    f = inv.files(spark, sf)
    kind = F.when(F.col("entry_id") % 23 == 7, "symlink").when(F.col("entry_id") % 59 == 9, "other").otherwise("file")
    no = F.lit(False)
    own = f.select("source_id", "path", kind.alias("kind"), "state", no.alias("mount"), no.alias("partial"), "size", "mtime_ns")
    zero = F.lit(0).cast("long")
    above = f.select("source_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), F.regexp_replace("path", "/[^/]*$", "/1").alias("at")).where("k < size(split(at, '/', -1))").distinct()
    folder = F.expr("substring_index(at, '/', k)")
    shut = (F.col("k") == 2) & F.col("at").startswith("en/7/") & (F.lit(ord("1") % 5) == 1)
    at = above.select(
        "source_id", folder.alias("path"), F.lit("directory").alias("kind"), F.when(shut, "unreadable").otherwise("present").alias("state"), ((F.col("k") == 2) & F.col("at").startswith("fr/3/")).alias("mount"),
        ((F.col("k") == 1) & F.col("at").startswith("es/") & F.col("source_id").endswith("3")).alias("partial"), zero.alias("size"), zero.alias("mtime_ns"),
    )
    return own.unionByName(at.distinct())


@query(
    "a1_figures",
    inv.sql(_ENTRIES, a.closure_sql("entries", True))
    + """, below AS (SELECT source_id, ancestor, count(*) FILTER (kind = 'directory') AS folders, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'other') AS specials, count(*) FILTER (state = 'unreadable') AS unreadable,
      count(*) FILTER (mount) AS mounts, bool_or(kind = 'directory' AND (partial OR state = 'unreadable')) AS part, count(*) FILTER (kind = 'file') AS files, CAST(coalesce(sum(size) FILTER (kind = 'file'), 0) AS BIGINT) AS bytes,
      min(mtime_ns) FILTER (kind = 'file' AND mtime_ns >= 86400000000000) AS oldest, max(mtime_ns) FILTER (kind = 'file' AND mtime_ns >= 86400000000000) AS newest FROM closure GROUP BY ALL)
    SELECT source_id, ancestor, folders, symlinks, specials, unreadable, mounts, part OR coalesce((SELECT bool_or(partial OR state = 'unreadable') FROM entries e WHERE e.kind = 'directory' AND e.source_id = b.source_id AND e.path = b.ancestor), false) AS partial,
      files, bytes, oldest, newest FROM below b""",
)
def a1_figures(spark, sf):
    return fold.figures(entries(spark, sf), by=["source_id"])


@query("a2_by_kind", _OC + " SELECT ancestor, kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM closure GROUP BY ALL")
def a2_kind(spark, sf):
    return fold.breakdown(a.tree_orders(spark, sf), "kind")


@query("a2_by_year", _OC + " SELECT ancestor, year, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM closure GROUP BY ALL")
def a2_year(spark, sf):
    return fold.breakdown(a.tree_orders(spark, sf), "year")


@query("a2_by_family", _OC + " SELECT ancestor, family, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM closure GROUP BY ALL")
def a2_family(spark, sf):
    return fold.breakdown(a.tree_orders(spark, sf), "family")


@query(
    "a3_composition",
    _OC
    + """, groups AS (SELECT ancestor AS group_path, min(family) AS group_family FROM closure WHERE level = 3 AND ancestor LIKE '%7' GROUP BY 1),
    shown AS (SELECT c.ancestor, c.size, coalesce((SELECT g.group_family FROM groups g WHERE g.group_path = array_to_string(list_slice(string_split(c.path, '/'), 1, 3), '/') AND c.level < 3), c.family) AS shown FROM closure c)
    SELECT ancestor, shown, CAST(sum(size) AS BIGINT) AS bytes FROM shown GROUP BY ALL""",
)
def a3(spark, sf):
    t = a.tree_orders(spark, sf)
    third = with_ancestors(t, True).where("level = 3 and ancestor like '%7'")
    groups = third.groupBy(F.col("ancestor").alias("group_path")).agg(F.min("family").alias("group_family"))
    return fold.composition(t, groups)


@query(
    "a4_main_kind",
    _OC
    + """, k AS (SELECT ancestor, kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM closure GROUP BY ALL)
    SELECT ancestor, kind, files, bytes FROM k QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY bytes DESC, files DESC, kind) = 1""",
)
def a4(spark, sf):
    return fold.main_kind(a.tree_orders(spark, sf))


@query(
    "a5_signal_counts",
    _OC + " SELECT ancestor, signal, count(*) AS n FROM (SELECT ancestor, unnest(list_concat(CASE WHEN size > 45 THEN ['large'] ELSE [] END, CASE WHEN kind = 'R' THEN ['returned'] ELSE [] END)) AS signal FROM closure) GROUP BY ALL",
)
def a5(spark, sf):
    signals = F.filter(F.array(F.when(F.col("size") > 45, "large"), F.when(F.col("kind") == "R", "returned")), lambda s: s.isNotNull())
    return with_ancestors(a.tree_orders(spark, sf), True).select("ancestor", F.explode(signals).alias("signal")).groupBy("ancestor", "signal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a6_smallest_paths",
    _OC + " SELECT ancestor, path, row_number() OVER (PARTITION BY ancestor ORDER BY path) AS rank FROM closure QUALIFY rank <= 20",
)
def a6(spark, sf):
    return fold.top_per_folder(a.tree_orders(spark, sf), 20, F.asc("path")).select("ancestor", "path", F.col("rank").cast("long").alias("rank"))


def _inside(level: int) -> str:
    """What stands out in the folders of a level, against each family: their files (or customers' orders below), and folders or what these list."""
    return f""", in{level} AS (SELECT folder, vs, path, bytes, is_folder FROM (
      SELECT parent AS folder, vs, path, bytes, false AS is_folder FROM leaf, fams WHERE depth = {level} AND family <> vs
      UNION ALL SELECT f.parent, fams.vs, f.ancestor, f.bytes, true FROM folder f, fams WHERE f.level = {level + 1} AND (f.is_group OR 2 * (CASE fams.vs WHEN 'F' THEN f.bf ELSE f.bo END) < f.bytes)
      UNION ALL SELECT f.parent, c.vs, c.path, c.bytes, c.is_folder FROM folder f JOIN in{level + 1} c ON c.folder = f.ancestor WHERE f.level = {level + 1} AND NOT f.is_group AND 2 * (CASE c.vs WHEN 'F' THEN f.bf ELSE f.bo END) >= f.bytes)
    QUALIFY row_number() OVER (PARTITION BY folder, vs ORDER BY bytes DESC, path) <= 10)"""


@query(
    "a7_notable",
    _OC
    + """, fams(vs) AS (VALUES ('F'), ('O')),
    leaf AS (SELECT path, size AS bytes, family, array_to_string(string_split(path, '/')[: -2], '/') AS parent, len(string_split(path, '/')) - 1 AS depth FROM tree_orders),
    folder AS (SELECT ancestor, level, array_to_string(string_split(ancestor, '/')[: -2], '/') AS parent, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (family = 'F'), 0) AS BIGINT) AS bf,
      CAST(coalesce(sum(size) FILTER (family = 'O'), 0) AS BIGINT) AS bo, level = 3 AND ancestor LIKE '%7' AS is_group FROM closure GROUP BY ALL),
    in5 AS (SELECT '' AS folder, '' AS vs, '' AS path, CAST(0 AS BIGINT) AS bytes, false AS is_folder WHERE false)"""
    + "".join(_inside(k) for k in (4, 3, 2, 1, 0))
    + " SELECT i.folder, i.path, i.bytes, i.is_folder, row_number() OVER (PARTITION BY i.folder ORDER BY i.bytes DESC, i.path) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT * FROM in{k}" for k in range(5))
    + ") i JOIN folder f ON f.ancestor = i.folder WHERE i.vs = CASE WHEN f.bf >= f.bo THEN 'F' ELSE 'O' END AND f.bytes > 0",
)
def a7(spark, sf):
    groups = a.customer_folders(spark, sf).where("path like '%7'")
    return fold.notable(a.tree_orders(spark, sf), groups, ["F", "O"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "a8_dominant",
    _OC
    + """, k AS (SELECT ancestor, family, CAST(sum(size) AS BIGINT) AS bytes FROM closure GROUP BY ALL)
    SELECT ancestor, family, bytes FROM k QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY bytes DESC, family) = 1""",
)
def a8(spark, sf):
    return fold.first_by(fold.breakdown(a.tree_orders(spark, sf), "family").select("ancestor", "family", "bytes"), ["ancestor"], F.desc("bytes"), F.asc("family"))


@query(
    "a17_home",
    _O + " SELECT kind, year, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM tree_orders GROUP BY ALL",
)
def a17(spark, sf):
    return a.tree_orders(spark, sf).groupBy("kind", "year").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(
    "a21_member_sums",
    a.with_tables(a.ARCHIVES_CONV)
    + " SELECT archive_id, string_split(path, '/')[1] AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT key) AS contents FROM archives_conv GROUP BY ALL",
)
def a21(spark, sf):
    return a.archives_conv(spark, sf).groupBy("archive_id", F.substring_index("path", "/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("key").alias("contents")
    )


@query(
    "a27_treemap_rest",
    _OC
    + """, c AS (SELECT ancestor, CAST(sum(size) AS BIGINT) AS bytes FROM closure WHERE level = 3 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, ancestor) AS rn FROM c)
    SELECT count(*) AS rest_count, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS rest_bytes FROM r WHERE rn > 300""",
)
def a27(spark, sf):
    c = fold.totals(a.tree_orders(spark, sf)).where("level = 3").select("ancestor", "bytes")
    top = c.orderBy(F.desc("bytes"), "ancestor").limit(300)
    sums = lambda d, p: d.agg(F.count(F.lit(1)).alias(p + "n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias(p + "b"))
    return sums(c, "a").join(F.broadcast(sums(top, "t"))).select((F.col("an") - F.col("tn")).alias("rest_count"), (F.col("ab") - F.col("tb")).alias("rest_bytes"))


@query(
    "a28_capped_count",
    _O + " SELECT count(*) > 10000 AS capped, least(count(*), 10000) AS shown FROM (SELECT 1 FROM tree_orders WHERE kind = 'N' LIMIT 10001)",
)
def a28(spark, sf):
    few = a.tree_orders(spark, sf).where("kind = 'N'").limit(10001)
    return few.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > 10000).alias("capped"), F.least("n", F.lit(10000)).alias("shown"))


@query(
    "a29_median",
    _O
    + """, r AS (SELECT year, mtime_s, row_number() OVER (PARTITION BY year ORDER BY mtime_s) AS r, count(*) OVER (PARTITION BY year) AS n FROM tree_orders)
    SELECT year, CAST((min(mtime_s) + max(mtime_s)) // 2 AS BIGINT) AS median FROM r WHERE r = (n + 1) // 2 OR r = n // 2 + 1 GROUP BY year""",
)
def a29(spark, sf):
    return dates.median_of(a.tree_orders(spark, sf), ["year"], "mtime_s", "median")


@query("j3_closure", a.with_tables(a.TREE_PAGES, a.closure_sql("tree_pages")) + " SELECT entry_id, path, ancestor, level FROM closure")
def j3(spark, sf):
    return with_ancestors(a.tree_pages(spark, sf)).select("entry_id", "path", "ancestor", F.col("level").cast("int").alias("level"))


@query(
    "o5_children_nulls",
    _OC + ", c AS (SELECT ancestor, CASE WHEN count(*) % 2 = 0 THEN max(mtime_s) END AS newest FROM closure WHERE level = 2 GROUP BY 1) SELECT ancestor, newest, row_number() OVER (ORDER BY newest ASC NULLS FIRST, ancestor) AS place FROM c QUALIFY place <= 50",
)
def o5(spark, sf):
    c = fold.totals(a.tree_orders(spark, sf)).where("level = 2").select("ancestor", F.when(F.col("files") % 2 == 0, F.col("newest")).alias("newest"))
    top = c.orderBy(F.asc_nulls_first("newest"), "ancestor").limit(50)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("newest"), "ancestor")).cast("long"))


@query(
    "o7_treemap",
    _OC + " SELECT ancestor, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM closure WHERE level = 3 GROUP BY 1 ORDER BY bytes DESC, ancestor LIMIT 300",
)
def o7(spark, sf):
    return fold.totals(a.tree_orders(spark, sf)).where("level = 3").select("ancestor", "bytes", "files").orderBy(F.desc("bytes"), "ancestor").limit(300)


@query(
    "i10_only_folder",
    _OC
    + """, kids AS (SELECT DISTINCT array_to_string(list_slice(string_split(ancestor, '/'), 1, level - 1), '/') AS parent, ancestor AS child FROM closure WHERE level BETWEEN 1 AND 4)
    SELECT parent, min(child) AS only_child FROM kids GROUP BY parent HAVING count(*) = 1""",
)
def i10(spark, sf):
    kids = with_ancestors(a.tree_orders(spark, sf), True).where("level between 1 and 4").select(
        F.when(F.col("level") == 1, "").otherwise(F.expr("substring_index(ancestor, '/', level - 1)")).alias("parent"), F.col("ancestor").alias("child")
    ).distinct()
    return kids.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("only_child")).where("n = 1").drop("n")


def _after(t):
    """The orders' tree after a change: lines gone, others of another size."""
    line = F.substring_index("path", "/", -1)
    lost, grown = (line == "1.r") & (F.col("size") % 3 == 0), (line == "2.n") & (F.col("size") % 2 == 0)
    return lost, grown


_AFTER = "after AS (SELECT * REPLACE (CASE WHEN path LIKE '%/2.n' AND size % 2 = 0 THEN size + 1000 ELSE size END AS size) FROM tree_orders WHERE NOT (path LIKE '%/1.r' AND size % 3 = 0))"
_FULL = " SELECT ancestor, level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(mtime_s) AS oldest, max(mtime_s) AS newest FROM closure GROUP BY ALL"


@query("t5_refold", a.with_tables(a.TREE_ORDERS, _AFTER, a.closure_sql("after", True)) + _FULL)
def t5(spark, sf):
    """The fold kept up with removed and grown files equals the fold of the tree after it."""
    t = a.tree_orders(spark, sf)
    lost, grown = _after(t)
    new = t.where(~lost).withColumn("size", F.when(grown, F.col("size") + 1000).otherwise(F.col("size")))
    return fold.refold(fold.totals(t), t.where(lost | grown), new.where(grown & ~lost), new)


_LATER = "later AS (SELECT * REPLACE (CASE WHEN path LIKE '%/3.a' THEN mtime_s + 86400 * CAST(size AS BIGINT) WHEN path LIKE '%/1.n' AND size = 50 THEN mtime_s - 900000000 ELSE mtime_s END AS mtime_s) FROM tree_orders)"


@query("t10_time_refold", a.with_tables(a.TREE_ORDERS, _LATER, a.closure_sql("later", True)) + _FULL)
def t10(spark, sf):
    """Only the times of some files change."""
    t = a.tree_orders(spark, sf)
    line = F.substring_index("path", "/", -1)
    late, early = line == "3.a", (line == "1.n") & (F.col("size") == 50)
    moved = F.when(late, F.col("mtime_s") + 86400 * F.col("size")).when(early, F.col("mtime_s") - 900_000_000).otherwise(F.col("mtime_s"))
    new = t.withColumn("mtime_s", moved)
    return fold.refold(fold.totals(t), t.where(late | early), new.where(late | early), new)


@query("t9_subtree_move", _O + " SELECT CASE WHEN path LIKE 'ASIA/%' THEN 'MOVED/' || substr(path, 6) ELSE path END AS path, size FROM tree_orders")
def t9(spark, sf):
    moved = F.when(F.col("path").startswith("ASIA/"), F.concat(F.lit("MOVED/"), F.expr("substring(path, 6)"))).otherwise(F.col("path"))
    return a.tree_orders(spark, sf).select(moved.alias("path"), "size")


@query("t11_delete_subtree", _O + " SELECT path, size FROM tree_orders WHERE NOT (path LIKE 'ASIA/%') AND NOT (path LIKE 'EUROPE/%')")
def t11(spark, sf):
    t = a.tree_orders(spark, sf)
    from granary.functions.paths import below

    return t.where(~below(F.col("path"), "ASIA") & ~below(F.col("path"), "EUROPE")).select("path", "size")
