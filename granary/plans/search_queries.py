"""Search filters, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.paths import extension, folded, glob_pattern, known_time, name, with_ancestors
from granary.functions.scalars import csv_guard, display_name
from granary.operators import classify, search
from granary.plans.registry import query
from granary.sources import adapters as a

_D = a.with_tables(a.TREE_DOCS, "files AS (SELECT *, string_split(path, '/')[-1] AS name FROM tree_docs)")
_N = "WITH parts AS (SELECT p_partkey AS entry_id, p_name AS name, p_type AS kind, p_size AS size, p_brand AS brand FROM part)"
_FOLD = "replace(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss')"


def docs(spark, sf):
    return a.tree_docs(spark, sf).withColumn("name", name(F.col("path")))


def parts(spark, sf):
    return a.table(spark, sf, "part").select(
        F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand")
    )


def found(q):
    return lambda spark, sf: docs(spark, sf).where(q.predicate()).select("entry_id")


for key, q, cond in (
    ("f1_source", search.Query(source="src3"), "source_id = 'src3'"),
    ("f4_extension", search.Query(extensions=[".TXT"], source="src4"), "source_id = 'src4' AND lower(regexp_extract(name, '^.+[.]([^.]+)$', 1)) = 'txt'"),
    ("f5_kind", search.Query(kinds=["de", "fr"]), "kind IN ('de', 'fr')"),
    ("f6_size", search.Query(min_size=1000, max_size=2000), "size BETWEEN 1000 AND 2000"),
    ("f8_within", search.Query(within="src1/en"), "path LIKE 'src1/en/%'"),
    ("f12_unreadable", search.Query(unreadable=True), "unreadable"),
):
    query(key, _D + f" SELECT entry_id FROM files WHERE {cond}")(found(q))


@query("f2_name_contains", _N + f" SELECT entry_id, name FROM parts WHERE contains({_FOLD}, 'bolt')")
def f2(spark, sf):
    return parts(spark, sf).where(search.Query(name="BÓLT").predicate()).select("entry_id", "name")


@query("f3_short_name", _N + " SELECT entry_id, name FROM parts WHERE contains(lower(name), 'ot')")
def f3(spark, sf):
    return parts(spark, sf).where(search.Query(name="Ot").predicate()).select("entry_id", "name")


@query("f7_years", _D + " SELECT entry_id FROM files WHERE mtime_ns >= 86400000000000 AND year(make_timestamp(mtime_ns // 1000)) BETWEEN 1973 AND 1976")
def f7(spark, sf):
    low, high = 94_694_400_000_000_000, 220_924_800_000_000_000  # 1973-01-01 and 1977-01-01 UTC
    t = known_time(F.col("mtime_ns"))
    return docs(spark, sf).where((t >= low) & (t < high)).select("entry_id")


@query("f13_quarantine", _D + " SELECT entry_id FROM files WHERE NOT (path = 'src19' OR path LIKE 'src19/%')")
def f13(spark, sf):
    return docs(spark, sf).where(~((F.col("path") == "src19") | F.col("path").startswith("src19/"))).select("entry_id")


@query("f23_glob", _N + " SELECT entry_id, name FROM parts WHERE lower(name) GLOB '*b?lt*'")
def f23(spark, sf):
    return parts(spark, sf).where(F.col("name").rlike(glob_pattern("*B?LT*"))).select("entry_id", "name")


@query("o1_sort", _D + " SELECT entry_id, size, row_number() OVER (ORDER BY size DESC, entry_id DESC) AS place FROM files QUALIFY place <= 200")
def o1(spark, sf):
    from pyspark.sql import Window

    top = search.page(docs(spark, sf), search.Query())
    return top.select("entry_id", "size", F.row_number().over(Window.orderBy(F.desc("size"), F.desc("entry_id"))).cast("long").alias("place"))


@query("o2_next_page", _D + " SELECT entry_id, size FROM files WHERE size < 3000 OR (size = 3000 AND entry_id < 500) ORDER BY size DESC, entry_id DESC LIMIT 50")
def o2(spark, sf):
    return search.page(docs(spark, sf), search.Query(), 50, search.encode_cursor(3000, 500)).select("entry_id", "size")


@query("o3_two_stage", _D + " SELECT entry_id, path, size, digest FROM files WHERE kind = 'en' ORDER BY size DESC, entry_id DESC LIMIT 100")
def o3(spark, sf):
    d = docs(spark, sf)
    ids = search.page(d.select("entry_id", "size", "kind"), search.Query(kinds=["en"]), 100).select("entry_id")
    return d.join(F.broadcast(ids), "entry_id").select("entry_id", "path", "size", "digest")  # 100 ids


@query("o12_resolve", _D + " SELECT entry_id FROM files WHERE size > 5000")
def o12(spark, sf):
    return search.resolve(docs(spark, sf), search.Query(min_size=5001))


@query("pj6_ref", "SELECT 'm' || conv_id AS ref, regexp_matches('m' || conv_id, '^m?[1-9][0-9]*$') AS valid FROM conversations")
def pj6(spark, sf):
    ref = F.concat(F.lit("m"), F.col("conv_id").cast("string"))
    return a.table(spark, sf, "conversations").select(ref.alias("ref"), ref.rlike("^m?[1-9][0-9]*$").alias("valid"))


@query("pj8_extension", _D + " SELECT entry_id, lower(regexp_extract(name, '^.+[.]([^.]+)$', 1)) AS ext FROM files")
def pj8(spark, sf):
    return docs(spark, sf).select("entry_id", extension(F.col("name")).alias("ext"))


@query("pj9_year_range", _D + " SELECT source_id, CAST(min(year(make_timestamp(mtime_ns // 1000))) FILTER (mtime_ns >= 86400000000000) AS INTEGER) AS first_year, CAST(max(year(make_timestamp(mtime_ns // 1000))) FILTER (mtime_ns >= 86400000000000) AS INTEGER) AS last_year FROM files GROUP BY 1")
def pj9(spark, sf):
    year = F.year(F.timestamp_micros(F.expr("mtime_ns div 1000")))
    known = F.when(known_time(F.col("mtime_ns")).isNotNull(), year)
    return docs(spark, sf).groupBy("source_id").agg(F.min(known).alias("first_year"), F.max(known).alias("last_year"))


@query("pj17_size_band", _D + " SELECT entry_id, CASE WHEN size < 1000 THEN 'small' WHEN size < 5000 THEN 'middle' WHEN size < 20000 THEN 'large' ELSE 'huge' END AS band FROM files")
def pj17(spark, sf):
    s = F.col("size")
    return docs(spark, sf).select("entry_id", F.when(s < 1000, "small").when(s < 5000, "middle").when(s < 20000, "large").otherwise("huge").alias("band"))


@query("pj13_tags", "SELECT doc_id AS entry_id, list_sort(list_filter([CASE WHEN toxic = 1 THEN 'flagged' END, CASE WHEN quality = 1 THEN 'good' END], lambda x: x IS NOT NULL)) AS tags FROM labels")
def pj13(spark, sf):
    tags = F.array_sort(F.filter(F.array(F.when(F.col("toxic") == 1, "flagged"), F.when(F.col("quality") == 1, "good")), lambda x: x.isNotNull()))
    return a.table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), tags.alias("tags"))


@query("s7_archive_format", "SELECT p_partkey AS entry_id, CASE p_partkey % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tar' END AS format FROM part")
def s7(spark, sf):
    suffix = F.element_at(F.array(F.lit(".ZIP"), F.lit(".tgz"), F.lit(".tar"), F.lit(".txt")), (F.col("p_partkey") % 4 + 1).cast("int"))
    n = F.concat("p_name", suffix)
    return a.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), classify.archive_format(n).alias("format"))


@query("s11_csv_guard", "SELECT doc_id, CASE WHEN regexp_matches(left(text, 1), '[=+@\\t\\r-]') THEN '''' || text ELSE text END AS cell FROM documents")
def s11(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", csv_guard(F.col("text")).alias("cell"))


@query("s12_json_rows", _D + """ SELECT entry_id, '{"entry_id":' || entry_id || ',"kind":"' || kind || '","size":' || size || '}' AS body FROM files""")
def s12(spark, sf):
    return docs(spark, sf).select("entry_id", F.to_json(F.struct("entry_id", "kind", "size")).alias("body"))


@query("u1_display_name", "SELECT page_id, replace(url, chr(92), chr(92) || chr(92)) || CASE page_id % 3 WHEN 0 THEN chr(92) || 'u{200B}' WHEN 1 THEN chr(92) || 'u{0009}' || chr(92) || 'xFF' ELSE chr(92) || chr(92) || 'é' END AS shown FROM pages")
def u1(spark, sf):
    """Addresses with a zero-width space, a tab and a bad byte, or a backslash at the end."""
    odd = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("E2808B"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("09FF"))).otherwise(F.unhex(F.lit("5CC3A9")))
    return a.table(spark, sf, "pages").select("page_id", display_name(F.concat(F.col("url").cast("binary"), odd)).alias("shown"))


