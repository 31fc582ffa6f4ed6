"""Content groups, places, relations, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import places, relations
from granary.plans.inventory_queries import tables
from granary.plans.registry import query
from granary.sources import adapters as a
from granary.sources import inventory as inv

_D = a.with_tables(a.TREE_DOCS, "files AS (SELECT * FROM tree_docs)")


def docs(spark, sf):
    return a.tree_docs(spark, sf)


@query("j5_physical_key", inv.sql() + f" SELECT entry_id, {inv._PHYS.format('f')} AS pkey FROM files f")
def j5(spark, sf):
    return inv.files(spark, sf).select("entry_id", places.physical_key().alias("pkey"))


@query("a34_member_coverage", _D + " SELECT kind, state, count(*) AS n FROM files GROUP BY ALL")
def a34(spark, sf):
    return docs(spark, sf).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


@query("d4_dictionary", _D + " SELECT digest, min(entry_id) AS first_id, max(size) AS size FROM files GROUP BY 1")
def d4(spark, sf):
    return docs(spark, sf).groupBy("digest").agg(F.min("entry_id").alias("first_id"), F.max("size").alias("size"))


_HERE = "state = 'present' AND NOT quarantined AND size > 0 AND content_state IS NOT NULL"


@query(
    "a19_dir_dups",
    inv.sql(
        f"figured AS (SELECT *, (SELECT count(DISTINCT pkey) FROM copy c WHERE c.digest = f.digest) AS copies FROM files f WHERE {_HERE})",
        a.closure_sql("figured", True),
    )
    + """ SELECT source_id, ancestor, CAST(coalesce(sum(size) FILTER (content_state NOT IN ('unique_size', 'unreadable')), 0) AS BIGINT) AS candidate,
      CAST(coalesce(sum(size) FILTER (content_state IN ('hashed', 'sampled')), 0) AS BIGINT) AS checked, CAST(coalesce(sum(size) FILTER (content_state = 'hashed' AND copies > 1), 0) AS BIGINT) AS duplicated,
      CAST(coalesce(sum(size) FILTER (content_state = 'unreadable'), 0) AS BIGINT) AS unreadable FROM closure GROUP BY ALL""",
)
def a19(spark, sf):
    files, _, copy = tables(spark, sf)
    return places.folder_duplication(files, copy)


@query("j6_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6(spark, sf):
    return a.table(spark, sf, "documents").join(a.table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j7_unreferenced", _D + " SELECT DISTINCT digest FROM files WHERE digest NOT IN (SELECT digest FROM files WHERE state = 'hashed') AND digest NOT IN (SELECT sha256(text) FROM benchmark)")
def j7(spark, sf):
    f = docs(spark, sf)
    used = f.where("state = 'hashed'").select("digest").unionByName(a.table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("digest")))
    return f.select("digest").distinct().join(used, "digest", "left_anti")


@query("j8_group_first", _D + " SELECT entry_id, min(entry_id) OVER (PARTITION BY digest) AS first_id FROM files")
def j8(spark, sf):
    f = docs(spark, sf).select("entry_id", "digest")
    return f.join(f.groupBy("digest").agg(F.min("entry_id").alias("first_id")), "digest").select("entry_id", "first_id")


_L = a.with_tables(a.TREE_LINES)
_PER = _L + ", per AS (SELECT folder, key, CAST(sum(size) AS BIGINT) AS bytes FROM tree_lines GROUP BY ALL), held AS (SELECT key FROM per GROUP BY key HAVING count(*) > 1), top3 AS (SELECT folder, key, bytes, row_number() OVER (PARTITION BY folder ORDER BY bytes DESC, key) AS rank FROM per JOIN held USING (key) QUALIFY rank <= 3)"


@query("w4_top3", _PER + " SELECT folder, key, bytes, rank FROM top3")
def w4(spark, sf):
    return relations.shared_keys(a.tree_lines(spark, sf), 3).select("folder", "key", "bytes", F.col("rank").cast("long").alias("rank"))


def _sides(spark, sf):
    """All files, dealt into two sides by their source's last letter; two neighbours by id share a relative path."""
    path = F.concat("kind", F.lit("/"), F.expr("entry_id div 2").cast("string"), F.lit(".txt"))
    known = F.when(F.col("state") == "hashed", F.col("digest"))
    empty = F.col("entry_id") % 97 == 6
    size = F.when(empty, 0).otherwise(F.col("size"))
    state = F.when(~empty, F.col("state"))
    rows = a.tree_docs(spark, sf).select((F.ascii(F.substring("source_id", -1, 1)) % 2 == 0).alias("is_left"), path.alias("path"), known.alias("digest"), size.alias("size"), state.alias("content_state"))
    return rows.where("is_left").drop("is_left"), rows.where("not is_left").drop("is_left")


_SIDES = a.with_tables(
    a.TREE_DOCS,
    """sides AS (SELECT ascii(right(source_id, 1)) % 2 = 0 AS is_left, kind || '/' || entry_id // 2 || '.txt' AS path, CASE WHEN entry_id % 97 = 6 THEN 0 ELSE size END AS size,
      CASE WHEN entry_id % 97 = 6 THEN 'empty' WHEN state = 'hashed' THEN digest END AS key, entry_id % 97 = 6 OR state IN ('hashed', 'sampled') AS known FROM tree_docs)""",
    "lk AS (SELECT * FROM sides WHERE is_left)",
    "rk AS (SELECT * FROM sides WHERE NOT is_left)",
    "nl AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS n FROM lk WHERE key IN (SELECT key FROM rk))",
    "nr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS n FROM rk WHERE key IN (SELECT key FROM lk))",
    """ident AS (SELECT 'identical' AS bucket, l.path AS left_path, r.path AS right_path, coalesce(l.size, r.size) AS size,
      CASE WHEN r.path IS NULL THEN (SELECT min(path) FROM rk WHERE rk.key = l.key) WHEN l.path IS NULL THEN (SELECT min(path) FROM lk WHERE lk.key = r.key) END AS twin
      FROM nl l FULL OUTER JOIN nr r ON l.key = r.key AND l.n = r.n)""",
    "ol AS (SELECT * FROM lk WHERE key IS NULL OR key NOT IN (SELECT key FROM rk WHERE key IS NOT NULL))",
    "orr AS (SELECT * FROM rk WHERE key IS NULL OR key NOT IN (SELECT key FROM lk WHERE key IS NOT NULL))",
    "diff AS (SELECT 'different' AS bucket, l.path AS left_path, r.path AS right_path, l.size, CAST(NULL AS VARCHAR) AS twin FROM ol l JOIN orr r ON l.path = r.path WHERE l.size <> r.size OR (l.known AND r.known))",
    """buckets AS (SELECT * FROM ident UNION ALL SELECT * FROM diff
      UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM rk WHERE rk.size = l.size AND NOT (l.known AND rk.known)) THEN 'unchecked' ELSE 'only_left' END, path, NULL, size, NULL FROM ol l WHERE path NOT IN (SELECT left_path FROM diff)
      UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM lk WHERE lk.size = r.size AND NOT (r.known AND lk.known)) THEN 'unchecked' ELSE 'only_right' END, NULL, path, size, NULL FROM orr r WHERE path NOT IN (SELECT right_path FROM diff))""",
)


@query("cp1_identical", _SIDES + " SELECT left_path, right_path, size, twin FROM buckets WHERE bucket = 'identical'")
def cp1(spark, sf):
    return relations.compare(*_sides(spark, sf)).where("bucket = 'identical'").drop("bucket")


@query("cp2_different", _SIDES + " SELECT left_path, right_path, size FROM buckets WHERE bucket = 'different'")
def cp2(spark, sf):
    return relations.compare(*_sides(spark, sf)).where("bucket = 'different'").select("left_path", "right_path", "size")


@query("cp3_only", _SIDES + " SELECT bucket, left_path, right_path, size FROM buckets WHERE bucket NOT IN ('identical', 'different')")
def cp3(spark, sf):
    return relations.compare(*_sides(spark, sf)).where("bucket not in ('identical', 'different')").drop("twin")


@query(
    "cp5_summary",
    _SIDES
    + """, ranks AS (SELECT unnest(['only_left', 'only_right', 'different', 'unchecked', 'identical']) AS bucket, unnest(range(5)) AS rank),
    full_counts AS (SELECT bucket, rank, count(size) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ranks LEFT JOIN buckets USING (bucket) GROUP BY ALL)
    SELECT bucket, files, bytes, rank = (SELECT coalesce(min(rank) FILTER (files > 0), 0) FROM full_counts) AS opened FROM full_counts""",
)
def cp5(spark, sf):
    return relations.summary(relations.compare(*_sides(spark, sf)))


_AMOUNTS = "[coalesce(sum(size) FILTER (k = 0), 0), coalesce(sum(size) FILTER (k = 1), 0), coalesce(sum(size) FILTER (k = 2), 0), 0, coalesce(sum(size) FILTER (k = 4), 0)]"


@query(
    "d10_split",
    a.with_tables(a.ARCHIVES_CONV, f"w AS (SELECT archive_id, sum(size) // 7 AS size, {_AMOUNTS}::HUGEINT[] AS w FROM (SELECT *, (archive_id + hash_free) % 5 AS k FROM (SELECT *, length(path) + CAST(size AS BIGINT) AS hash_free FROM archives_conv)) GROUP BY 1)", places.split_sql("w"))
    + " SELECT archive_id, shares FROM split",
)
def d10(spark, sf):
    """Each conversation as an archive of a seventh of its members' bytes, dealt over five places."""
    members = a.archives_conv(spark, sf).withColumn("k", (F.col("archive_id") + F.length("path") + F.col("size")) % 5)
    amount = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("size"))), F.lit(0)).cast("long")
    per = members.groupBy("archive_id").agg(F.expr("sum(size) div 7").alias("size"), F.array(amount(0), amount(1), amount(2), F.lit(0).cast("long"), amount(4)).alias("weights"))
    return per.select("archive_id", places.split_archive(F.col("size"), F.col("weights")).alias("shares"))


@query("t1_union", _D + ",m AS (SELECT key, size FROM (" + a.ARCHIVES_CONV.strip().split("AS (", 1)[1].rsplit(")", 1)[0] + ")) SELECT digest AS key, size, 'file' AS arm FROM files UNION ALL SELECT key, size, 'member' FROM m")
def t1(spark, sf):
    f = docs(spark, sf).select(F.col("digest").alias("key"), "size", F.lit("file").alias("arm"))
    return f.unionByName(a.archives_conv(spark, sf).select("key", "size", F.lit("member").alias("arm")))


_WRAP = _SIDES + """, wrapped AS (SELECT 'backup/' || path AS path, key FROM sides WHERE NOT is_left),
  bare AS (SELECT substr(path, 8) AS path, key FROM wrapped),
  gone AS (SELECT (SELECT count(*) FROM bare WHERE path IN (SELECT path FROM sides WHERE is_left)) > (SELECT count(*) FROM wrapped WHERE path IN (SELECT path FROM sides WHERE is_left))
    AND (SELECT count(DISTINCT string_split(path, '/')[1]) FROM sides WHERE is_left) > 1 AS g)"""


@query("cp4_drop_wrapper", _WRAP + " SELECT CASE WHEN g THEN substr(path, 8) ELSE path END AS path, key FROM wrapped, gone")
def cp4(spark, sf):
    left, right = _sides(spark, sf)
    wrapped = right.withColumn("path", F.concat(F.lit("backup/"), F.col("path")))
    key = F.when(relations.is_empty(F.col("size"), F.col("content_state")), "empty").otherwise(F.col("digest"))
    return relations.drop_wrapper(left, wrapped)[1].select("path", key.alias("key"))
