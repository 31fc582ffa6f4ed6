"""Review lists, row figures and plan checks over the inventory.

A15, A31, A32, D13, D14, D20, F17, M13, O13, PJ3, PJ7, PJ11, PJ14, PJ16-PJ18, R5,
R10, W2, X7, X14, X19.  The SQL compares folders pair by pair and tests paths by
prefix; the operators join keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.paths import extension, known_time, name, with_ancestors
from granary.operators import places, review
from granary.plans.inventory_queries import _PJ2, _PLACED, placed, tables
from granary.plans.registry import query
from granary.sources import adapters as a
from granary.sources import inventory as inv
from granary.sources import nested

_AT = "source_id || '/' || path"
_HELD = "content_state = 'hashed' AND state = 'present' AND NOT quarantined AND size > 0"
_FF = f"ff AS (SELECT entry_id, regexp_replace({_AT}, '/[^/]*$', '') AS folder, digest AS key, size FROM files WHERE {_HELD})"
_IN = """fk AS (SELECT DISTINCT folder, key FROM ff),
own AS (SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS total, string_agg(key, ',' ORDER BY key) AS sig FROM ff GROUP BY 1),
hit AS (SELECT x.folder AS a, y.folder AS b, count(*) AS n FROM ff x JOIN fk y ON x.key = y.key AND x.folder <> y.folder GROUP BY 1, 2),
ins AS (SELECT a, b, total AS matched FROM hit JOIN own ON own.folder = a WHERE n = files),
sided AS (SELECT i.*, EXISTS (SELECT 1 FROM ins r WHERE r.a = i.b AND r.b = i.a) AS same FROM ins i),
reps AS (SELECT folder, min(folder) OVER (PARTITION BY sig) AS rep FROM own),
rel AS (SELECT s.a, s.b, CASE WHEN same THEN 'same' ELSE 'inside' END AS relation, matched FROM sided s JOIN reps p ON p.folder = s.a JOIN reps q ON q.folder = s.b
  WHERE (NOT same OR a < b) AND (p.rep = q.rep AND (p.rep = a OR q.rep = b) OR p.rep <> q.rep AND p.rep = a AND q.rep = b))"""


def folder_files(spark, sf):
    at = F.concat_ws("/", "source_id", "path")
    return inv.files(spark, sf).where(_HELD).select(F.regexp_replace(at, "/[^/]*$", "").alias("folder"), F.col("digest").alias("key"), "size")


@query(
    "a15_duplicate_groups",
    inv.sql(_FF, _IN)
    + """, sides AS (SELECT a AS folder FROM rel UNION SELECT b FROM rel),
    within AS (SELECT c.*, EXISTS (SELECT 1 FROM sides s WHERE starts_with(c.source_id || '/' || c.at_path, s.folder || '/')) AS inside FROM copy c),
    per AS (SELECT digest, max(size) AS size, count(DISTINCT pkey) AS keys, count(DISTINCT pkey) FILTER (inside) AS held FROM within GROUP BY 1)
    SELECT digest, keys - held - CASE WHEN held = 0 THEN 1 ELSE 0 END AS files, CAST(size * (keys - held - CASE WHEN held = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM per WHERE keys > 1 AND keys > held""",
)
def a15(spark, sf):
    found = review.listed(folder_files(spark, sf))
    sides = found.select(F.explode(F.array("a", "b")).alias("folder"))
    return review.duplicate_groups(tables(spark, sf)[2], sides)


@query("d13_relations", inv.sql(_FF, _IN) + " SELECT a, b, relation, matched FROM rel")
def d13(spark, sf):
    return review.listed(folder_files(spark, sf)).select("a", "b", "relation", "matched")


@query(
    "w2_covered_by",
    inv.sql(_FF, _IN)
    + """, arms AS (SELECT a AS folder, b AS other, relation, matched, a, b FROM rel UNION ALL SELECT b, a, relation, matched, a, b FROM rel WHERE relation = 'same')
    SELECT folder, other, relation, matched FROM arms QUALIFY row_number() OVER (PARTITION BY folder ORDER BY matched DESC, a, b) = 1""",
)
def w2(spark, sf):
    return review.covered_by(review.listed(folder_files(spark, sf)))


@query(
    "d14_unpacked",
    f"""WITH {nested.SQL},
    held AS (SELECT *, source_id || '/' || archive AS z, source_id || '/' || array_to_string(string_split(path, '/')[: 2], '/') AS folder FROM line_files WHERE size > 0),
    whole AS MATERIALIZED (SELECT z, list_sort(list_distinct(list(digest))) AS ks FROM held WHERE archive IS NOT NULL GROUP BY 1 HAVING bool_and(digest IS NOT NULL)),
    fs AS MATERIALIZED (SELECT folder, list_sort(list_distinct(list(digest))) AS ks FROM held WHERE archive IS NULL AND digest IS NOT NULL GROUP BY 1)
    SELECT z AS archive, folder, w.ks = fs.ks AS same FROM whole w JOIN fs ON list_has_all(fs.ks, w.ks) QUALIFY row_number() OVER (PARTITION BY z ORDER BY same DESC, folder) = 1""",
)
def d14(spark, sf):
    """Archives of the nested tree whose lines lie in one document's folder; one with a line that was not read is left out."""
    rows = nested.files(spark, sf).where("size > 0")
    z = rows.where("archive is not null").withColumn("folder", F.concat_ws("/", "source_id", "archive"))
    open_ = z.where("digest is null").select("folder").distinct()
    folder = F.concat_ws("/", "source_id", F.substring_index("path", "/", 2))
    named = rows.where("archive is null and digest is not null").withColumn("folder", folder)
    keyed = lambda d: d.select("folder", F.col("digest").alias("key"), "size")
    return review.unpacked(keyed(z.join(open_, "folder", "left_anti")), keyed(named))


@query(
    "r10_picked",
    inv.sql(_FF, _IN)
    + " SELECT a AS folder, b AS partner, same AS twin FROM sided QUALIFY row_number() OVER (PARTITION BY a ORDER BY same, len(string_split(b, '/')) DESC, b) = 1",
)
def r10(spark, sf):
    return review.picked(folder_files(spark, sf))


@query(
    "r5_lift",
    a.with_tables(
        a.TREE_PAGES,
        a.closure_sql("tree_pages"),
        "n AS (SELECT ancestor AS folder, level, count(*) AS files FROM closure GROUP BY 1, 2)",
    )
    + """ SELECT d.folder, (SELECT min_by(u.folder, u.level) FROM n u WHERE u.files = d.files AND (u.folder = d.folder OR starts_with(d.folder, u.folder || '/'))) AS lifted,
      (SELECT max_by(l.folder, l.level) FROM n l WHERE l.files = d.files AND (l.folder = d.folder OR starts_with(l.folder, d.folder || '/'))) AS lowered FROM n d""",
)
def r5(spark, sf):
    return review.chains(a.tree_pages(spark, sf))


_CELLS = """cells AS (SELECT source_id, family, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM keyed GROUP BY 1, 2),
ranked AS (SELECT *, list_position(['personal', 'programs', 'disposable', 'containers'], family) AS rank FROM cells)"""


def composed(spark, sf):
    rows = inv.files(spark, sf).withColumn("family", places.file_family(F.col("category"), F.col("file_kind")))
    return review.families(rows, "source_id")


@query("pj3_composition", inv.sql(_PLACED, _CELLS) + " SELECT source_id, rank, family, bytes, files FROM ranked")
def pj3(spark, sf):
    return composed(spark, sf).select("source_id", F.inline("composition")).withColumn("rank", F.col("rank").cast("long"))


@query(
    "pj18_mixed_share",
    inv.sql(_PLACED, _CELLS)
    + """, main AS (SELECT source_id, first(family ORDER BY bytes DESC, rank) AS family, max(bytes) AS bytes, sum(bytes) AS total FROM ranked GROUP BY 1)
    SELECT source_id, CASE WHEN mixed THEN family END AS family, CASE WHEN mixed THEN bytes / total END AS fraction FROM (SELECT *, total > 0 AND (total - bytes) * 100 >= total AS mixed FROM main)""",
)
def pj18(spark, sf):
    return composed(spark, sf).select("source_id", review.mixed_share(F.col("composition")).alias("m")).select("source_id", "m.family", "m.fraction")


_BAND = """CASE WHEN NOT checked THEN 'unchecked' WHEN fraction IS NULL THEN NULL WHEN fraction <= 0 THEN 'none' WHEN fraction < 0.25 THEN 'under25' WHEN fraction < 0.5 THEN 'under50'
  WHEN fraction < 0.75 THEN 'under75' ELSE 'over75' END"""
_SHOWN = f"shown AS (SELECT k.*, {_PJ2} AS copies FROM keyed k)"


@query(
    "pj16_duplication",
    inv.sql(_PLACED, _SHOWN)
    + f""" SELECT entry_id, fraction, checked, {_BAND} AS band FROM (SELECT entry_id, CASE WHEN content_state IS NOT NULL THEN CAST(content_state NOT IN ('pending', 'changed', 'unreadable') AND coalesce(copies, 1) > 1 AS INT)::DOUBLE END AS fraction,
      content_state NOT IN ('pending', 'changed', 'unreadable') AS checked FROM shown)""",
)
def pj16(spark, sf):
    rows = placed(spark, sf).select("entry_id", review.file_duplication(F.col("content_state"), places.shown_copies()).alias("d")).select("entry_id", "d.fraction", "d.checked")
    return rows.withColumn("band", review.duplication_band(F.col("fraction"), F.col("checked")))


@query(
    "pj16_folder_duplication",
    inv.sql(_PLACED, _SHOWN, a.closure_sql("shown", True))
    + f""" SELECT source_id, ancestor, fraction, checked, {_BAND} AS band FROM (SELECT source_id, ancestor, CASE WHEN sum(size) > 0 THEN coalesce(sum(size) FILTER (content_state = 'hashed' AND copies > 1), 0) / sum(size) ELSE 0 END AS fraction,
      coalesce(sum(size) FILTER (content_state IN ('hashed', 'sampled')), 0) >= coalesce(sum(size) FILTER (content_state <> 'unique_size'), 0) AS checked FROM closure WHERE state = 'present' AND NOT quarantined GROUP BY 1, 2)""",
)
def pj16_folder(spark, sf):
    rows = placed(spark, sf).where("state = 'present' and not quarantined").withColumn("copies", places.shown_copies())
    found = review.folder_duplication(with_ancestors(rows.select("source_id", "path", "size", "content_state", "copies"), True), "source_id", "ancestor")
    return found.withColumn("band", review.duplication_band(F.col("fraction"), F.col("checked")))


_NOW = 400_000_000


@query(
    "pj17_age_band",
    inv.sql()
    + f""" SELECT entry_id, CASE WHEN mtime_ns < 86400000000000 THEN NULL WHEN y < 1 THEN 'year1' WHEN y < 3 THEN 'year3' WHEN y < 5 THEN 'year5' WHEN y < 10 THEN 'year10' ELSE 'older' END AS band
      FROM (SELECT entry_id, mtime_ns, ({_NOW} - mtime_ns / 1e9) / (365.25 * 86400) AS y FROM files)""",
)
def pj17(spark, sf):
    return inv.files(spark, sf).select("entry_id", review.age_band(F.col("mtime_ns"), _NOW).alias("band"))


@query("pj7_known_time", inv.sql() + " SELECT entry_id, CASE WHEN mtime_ns >= 86400 * CAST(1000000000 AS BIGINT) THEN mtime_ns END AS mtime_ns FROM files")
def pj7(spark, sf):
    return inv.files(spark, sf).select("entry_id", known_time(F.col("mtime_ns").cast("long")).alias("mtime_ns"))


_STEPS = """steps AS (SELECT l_orderkey, l_linenumber, ['cleanup', 'restore', 'rename', 'rescue'][1 + l_orderkey % 4] AS kind, ['rename', 'mkdir', 'rmdir', 'record', 'unlink', 'purge', 'verify'][l_linenumber] AS op FROM lineitem)"""


@query(
    "pj11_operation",
    f"WITH {_STEPS} "
    + """SELECT l_orderkey, l_linenumber, CASE WHEN op = 'rename' AND kind = 'cleanup' THEN 'quarantine' WHEN op = 'rename' AND kind IN ('restore', 'rename') THEN kind WHEN op = 'rename' THEN 'move'
      WHEN op = 'mkdir' THEN 'create_folder' WHEN op = 'rmdir' THEN 'remove_folder' WHEN op = 'record' THEN 'write_record' WHEN op = 'unlink' THEN 'remove_record' ELSE op END AS label FROM steps""",
)
def pj11(spark, sf):
    kind = F.expr("element_at(array('cleanup', 'restore', 'rename', 'rescue'), cast(1 + l_orderkey % 4 as int))")
    op = F.expr("element_at(array('rename', 'mkdir', 'rmdir', 'record', 'unlink', 'purge', 'verify'), cast(l_linenumber as int))")
    return a.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", review.operation(kind, op).alias("label"))


@query(
    "pj14_archive_note",
    inv.sql()
    + """ SELECT entry_id, CASE WHEN a.archive_id IS NULL AND path LIKE '%.zip' AND state = 'present' THEN 'not_listed' WHEN a.archive_id IS NULL AND path LIKE '%.MP3' THEN 'unsupported' END AS note
      FROM files f LEFT JOIN archives a ON a.archive_id = f.entry_id AND a.listing = 'complete'""",
)
def pj14(spark, sf):
    """Archives without a complete listing; in this inventory .mp3 stands for a form that is not opened."""
    done = inv.archives(spark, sf).where("listing = 'complete'").select(F.col("archive_id").alias("entry_id"), F.lit(True).alias("listed"))
    note = review.archive_note(F.lit(False), extension(name(F.col("path"))), F.col("state"), F.col("listed"), ("zip",), ("mp3",))
    return inv.files(spark, sf).join(done, "entry_id", "left").select("entry_id", note.alias("note"))


_MEDIA = "file_kind IN ('image', 'video') AND state = 'present' AND NOT quarantined"


@query("f17_media", inv.sql() + f" SELECT entry_id FROM files WHERE {_MEDIA}")
def f17(spark, sf):
    return review.media(inv.files(spark, sf)).select("entry_id")


@query("m13_targets", inv.sql() + f" SELECT entry_id FROM files WHERE {_MEDIA} AND (triage = 'discard' OR size > 3000 OR starts_with({_AT}, 'src1/') OR starts_with({_AT}, 'src2/en/'))")
def m13(spark, sf):
    """Targets: large or discarded entries, and two folders."""
    files = inv.files(spark, sf)
    folders = spark.createDataFrame([("src1",), ("src2/en",)], "folder string")
    return review.expanded(files, files.where("triage = 'discard' or size > 3000").select("entry_id"), folders)


_KEEPS = f"""keeps AS (SELECT {_AT} AS path FROM files JOIN labels ON doc_id = entry_id WHERE quality = 1
  UNION SELECT DISTINCT source || '/' || lang || '/1' FROM documents)"""


@query(
    "x7_rescue_plan",
    inv.sql(_KEEPS, f"folders AS (SELECT DISTINCT source_id AS folder FROM files UNION SELECT DISTINCT source_id || '/' || split_part(path, '/', 1) FROM files UNION SELECT DISTINCT regexp_replace({_AT}, '/[^/]*$', '') FROM files)")
    + """, under AS (SELECT folder, path FROM folders JOIN keeps ON starts_with(path, folder || '/'))
    SELECT folder, path FROM under u WHERE NOT EXISTS (SELECT 1 FROM under o WHERE o.folder = u.folder AND starts_with(u.path, o.path || '/'))""",
)
def x7(spark, sf):
    files, docs = inv.files(spark, sf), a.table(spark, sf, "documents")
    at = F.concat_ws("/", "source_id", "path")
    good = a.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("entry_id"))
    ones = docs.select(F.concat_ws("/", "source", "lang", F.lit("1")).alias("path")).distinct()
    keeps = files.join(good, "entry_id", "left_semi").select(at.alias("path")).unionByName(ones)
    folders = files.select(F.explode(F.array("source_id", F.concat_ws("/", "source_id", F.substring_index("path", "/", 1)), F.regexp_replace(at, "/[^/]*$", ""))).alias("folder")).distinct()
    return review.rescue_plan(folders, keeps)


@query(
    "x19_kept_within",
    inv.sql(f"e AS (SELECT {_AT} AS path, triage = 'review' AND size > 2000 AS kept FROM files)", a.closure_sql("e"))
    + " SELECT path, bool_or(kept) AS kept FROM (SELECT ancestor AS path, kept FROM closure UNION ALL SELECT path, kept FROM e) GROUP BY 1",
)
def x19(spark, sf):
    decision = F.when((F.col("triage") == "review") & (F.col("size") > 2000), "keep").otherwise("undecided")
    return review.kept_within(inv.files(spark, sf).select(F.concat_ws("/", "source_id", "path").alias("path"), decision.alias("decision")))


@query(
    "x14_stale",
    inv.sql(f"items AS (SELECT entry_id % 50 AS check_id, {_AT} AS path FROM files WHERE triage = 'discard')", f"changed AS (SELECT {_AT} AS path FROM files WHERE content_state = 'changed' UNION SELECT DISTINCT source_id || '/fr/3' FROM files)")
    + " SELECT DISTINCT check_id FROM items i WHERE EXISTS (SELECT 1 FROM changed c WHERE c.path = i.path OR starts_with(i.path, c.path || '/'))",
)
def x14(spark, sf):
    files, at = inv.files(spark, sf), F.concat_ws("/", "source_id", "path")
    items = files.where("triage = 'discard'").select((F.col("entry_id") % 50).alias("check_id"), at.alias("path"))
    changed = files.where("content_state = 'changed'").select(at.alias("path")).unionByName(files.select(F.concat("source_id", F.lit("/fr/3")).alias("path")).distinct())
    return review.stale(items, changed)


@query(
    "a31_freed",
    inv.sql(_PLACED)
    + """, gone AS (SELECT source_id, pkey, count(*) AS names, sum(size) AS size, max(size) AS one, CASE WHEN left(pkey, 1) = 'h' THEN max(nlink) ELSE 1 END AS links FROM keyed WHERE size < 4000 GROUP BY 1, 2)
    SELECT source_id, CAST(sum(names) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN names >= links THEN one ELSE 0 END) AS BIGINT) AS freed FROM gone GROUP BY 1""",
)
def a31(spark, sf):
    return review.freed(inv.files(spark, sf).where("size < 4000"), "source_id")


@query(
    "a32_to_read",
    inv.sql(a.closure_sql("files", True)) + " SELECT source_id, ancestor, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM closure WHERE state = 'present' AND size > 0 GROUP BY 1, 2",
)
def a32(spark, sf):
    return review.to_read(inv.files(spark, sf))


@query(
    "d20_member_folders",
    inv.sql("own AS (SELECT m.*, coalesce(content_state = 'hashed' AND (SELECT count(DISTINCT pkey) FROM copy c WHERE c.digest = m.digest) > 1, false) AS copied FROM members m)", a.closure_sql("own", True))
    + " SELECT archive_id, ancestor, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (copied) AS copied FROM closure GROUP BY 1, 2",
)
def d20(spark, sf):
    members = places.resolve_links(inv.raw_members(spark, sf))
    many = places.contents(tables(spark, sf)[2]).where("n_copies > 1").select("digest", F.lit(True).alias("many"))
    copied = F.coalesce((F.col("content_state") == "hashed") & F.col("many"), F.lit(False))
    return review.member_folders(members.join(many, "digest", "left").withColumn("copied", copied))


@query(
    "o13_quarantine",
    "SELECT doc_id AS entry_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id % 13 DESC, n_chars % 101 DESC, doc_id DESC) AS rank FROM documents",
)
def o13(spark, sf):
    d = a.table(spark, sf, "documents")
    items = d.select(F.col("doc_id").alias("entry_id"), "source", (F.col("doc_id") % 13).cast("string").alias("plan"), F.concat((F.col("n_chars") % 101).cast("string"), F.lit("-x")).alias("seq"))
    return review.newest_plan_first(items, "source").select("entry_id", "source", "rank")


#: Files of the inventory with two folders a source: a cache with what lies below it, and one without files.
_LISTED = """listable AS (SELECT entry_id, source_id, path, 'file' AS kind, state, quarantined, category, size AS bytes, 1 AS files, entry_id % 10 = 2 AS partial_download, true AS complete FROM files
  UNION ALL SELECT -1 - ascii(right(source_id, 1)) - 100 * length(source_id), source_id, 'en/2', 'directory', 'present', false, 'cache', CAST(sum(size) AS BIGINT), count(*), false, true FROM files WHERE path LIKE 'en/2/%' GROUP BY source_id
  UNION ALL SELECT DISTINCT -10001 - ascii(right(source_id, 1)) - 100 * length(source_id), source_id, 'fr/empty', 'directory', 'present', false, 'unknown', CAST(0 AS BIGINT), 0, false, source_id NOT LIKE '%4' FROM files),
own_lists AS (SELECT *, CASE WHEN category = 'system_junk' THEN 'system_junk' WHEN category = 'installer_download' THEN 'installers' WHEN category IN ('application_installation', 'os_installation') THEN 'programs'
  WHEN category IN ('cache', 'temporary_data', 'generated_artifacts') THEN CASE WHEN partial_download THEN 'leftovers' ELSE 'caches' END END AS by_rule,
  (kind = 'file' AND bytes = 0) OR (kind = 'directory' AND files = 0 AND state = 'present' AND complete) AS empty FROM listable WHERE state <> 'missing' AND NOT quarantined),
both_lists AS (SELECT entry_id, source_id, path, bytes, by_rule AS list FROM own_lists WHERE by_rule IS NOT NULL UNION SELECT entry_id, source_id, path, bytes, 'leftovers' FROM own_lists WHERE empty),
list_rows AS (SELECT * FROM both_lists r WHERE NOT EXISTS (SELECT 1 FROM both_lists o WHERE o.list = r.list AND o.source_id = r.source_id AND starts_with(r.path, o.path || '/'))),
open_rows AS (SELECT r.*, quality IS NULL AS is_open FROM list_rows r LEFT JOIN labels ON doc_id = entry_id)"""


def list_rows(spark, sf):
    f = inv.files(spark, sf)
    columns = ["entry_id", "source_id", "path", "kind", "state", "quarantined", "category", "bytes", "files", "partial_download", "complete"]
    own = f.withColumns({"kind": F.lit("file"), "bytes": F.col("size"), "files": F.lit(1).cast("long"), "partial_download": F.col("entry_id") % 10 == 2, "complete": F.lit(True)})
    code = F.ascii(F.substring("source_id", -1, 1)) + 100 * F.length("source_id")
    plain = {"kind": F.lit("directory"), "state": F.lit("present"), "quarantined": F.lit(False), "partial_download": F.lit(False)}
    cache = f.where("path like 'en/2/%'").groupBy("source_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
    cache = cache.withColumns({**plain, "entry_id": (-1 - code).cast("long"), "path": F.lit("en/2"), "category": F.lit("cache"), "complete": F.lit(True)})
    empty = f.select("source_id").distinct().withColumns({**plain, "entry_id": (-10001 - code).cast("long"), "path": F.lit("fr/empty"), "category": F.lit("unknown"), "bytes": F.lit(0).cast("long"), "files": F.lit(0).cast("long")})
    empty = empty.withColumn("complete", ~F.col("source_id").endswith("4"))
    return review.rule_lists(own.select(*columns).unionByName(cache.select(*columns)).unionByName(empty.select(*columns)))


def open_rows(spark, sf):
    """The lists' rows; what the owner has judged is decided."""
    judged = a.table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), F.col("quality").isNotNull().alias("judged"))
    return list_rows(spark, sf).join(judged, "entry_id", "left").withColumn("is_open", ~F.coalesce("judged", F.lit(False)))


@query("d12_rule_lists", inv.sql(_LISTED) + " SELECT entry_id, list, bytes FROM list_rows")
def d12(spark, sf):
    return list_rows(spark, sf).select("entry_id", "list", "bytes")


@query(
    "a18_cards",
    inv.sql(_LISTED)
    + """, lists AS (SELECT unnest(['rescue', 'duplicates', 'unpacked_archives', 'system_junk', 'installers', 'programs', 'caches', 'leftovers']) AS list, unnest(range(8)) AS rank),
    sums AS (SELECT list, rank, count(*) FILTER (is_open) AS open_rows, CAST(coalesce(sum(bytes) FILTER (is_open), 0) AS BIGINT) AS open_bytes, count(*) FILTER (NOT is_open) AS decided_rows,
      CAST(coalesce(sum(bytes) FILTER (NOT is_open), 0) AS BIGINT) AS decided_bytes FROM lists LEFT JOIN open_rows USING (list) GROUP BY ALL)
    SELECT list, open_rows, open_bytes, decided_rows, decided_bytes, row_number() OVER (ORDER BY list = 'rescue' AND open_rows > 0 DESC, open_bytes DESC, rank) AS place FROM sums""",
)
def a18(spark, sf):
    return review.cards(open_rows(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("o8_review_page", inv.sql(_LISTED) + " SELECT entry_id, bytes FROM open_rows WHERE list = 'caches' AND is_open ORDER BY bytes DESC, entry_id DESC LIMIT 51")
def o8(spark, sf):
    return review.page(open_rows(spark, sf), "caches", False).select("entry_id", "bytes")
