"""Signals, kinds and classification by a small rule pack (C1-C6, C8-C11, PJ10, PJ12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.paths import name
from granary.operators import rules
from granary.operators.rules import Pack, Rule, Share, Signal
from granary.plans.registry import query
from granary.sources import inventory as inv
from granary.sources.adapters import closure_sql, table

PACK = Pack(
    signals=(Signal("mail", ("*.eml",), ("*5.eml",)), Signal("copy", ("*.bak", "*.zip")), Signal("photo", ("*.jpg",), indicator=True)),
    files=(
        Rule("temp", 60, "temporary_data", names=("*.tmp",), explain="Scratch files of programs."),
        Rule("photo", 50, "personal_media", names=("*.jpg", "*.mp3"), traits=("contains_user_material",), explain="Pictures and music."),
        Rule("mail", 50, "documents", names=("*.eml", "*1?.jpg"), explain="Letters and scans."),
        Rule("setup", 40, "installer_download", names=("*.exe",)),
        Rule("copy", 30, "backup", names=("*.bak", "*.zip"), review=True),
        Rule("text", 20, "documents", share=Share(("document",), 1, 1.0)),
        Rule("sevens", 10, names=("*7.*",), traits=("contains_database",)),
    ),
    folders=(
        Rule("scratch", 60, "temporary_data", names=("1?",), child_none=("mail",)),
        Rule("album", 50, "personal_media", share=Share(("image", "audio"), 2, 0.3)),
        Rule("archive", 50, "backup", subtree={"copy": 3}, review=True),
        Rule("letters", 40, "documents", child_any=("mail",), traits=("contains_user_material",)),
    ),
    kind_names=(("document", ("readme*",)),),
    kind_of={"iso": "installer", "jpg": "image", "txt": "document"},
    pairs=(("bin", "cue", "installer"),),
)


def named(spark, sf):
    return inv.files(spark, sf).withColumn("name", name(F.col("path")))


_N = "named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS low FROM files)"
_SIG = "list_filter([CASE WHEN low LIKE '%.eml' AND low NOT LIKE '%5.eml' THEN 'mail' END, CASE WHEN low LIKE '%.bak' OR low LIKE '%.zip' THEN 'copy' END, CASE WHEN low LIKE '%.jpg' THEN 'photo' END], lambda x: x IS NOT NULL)"


@query("c1_name_signals", inv.sql(_N) + f" SELECT entry_id, {_SIG} AS signals FROM named")
def c1(spark, sf):
    return named(spark, sf).select("entry_id", rules.name_signals(F.col("name"), PACK.signals).alias("signals"))


_PARTS = """discs AS (SELECT p_partkey AS entry_id, p_brand AS folder, CASE WHEN p_partkey % 40 = 7 THEN 'ReadMe.iso' ELSE 'Disc' || (p_partkey // 4) % 9 || CASE p_partkey % 5 WHEN 0 THEN '.BIN' WHEN 1 THEN '.cue' WHEN 2 THEN '.iso' WHEN 3 THEN '.Jpg' ELSE '.dat' END END AS name FROM part),
d AS (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM discs)"""


@query(
    "c2_file_kind",
    "WITH " + _PARTS + """ SELECT entry_id, CASE WHEN lower(name) LIKE 'readme%' THEN 'document' WHEN ext = 'iso' THEN 'installer' WHEN ext = 'jpg' THEN 'image' WHEN ext = 'txt' THEN 'document'
    WHEN ext = 'bin' AND EXISTS (SELECT 1 FROM d o WHERE o.folder = d.folder AND o.stem = d.stem AND o.ext = 'cue') THEN 'installer' ELSE 'other' END AS file_kind FROM d""",
)
def c2(spark, sf):
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".BIN", ".cue", ".iso", ".Jpg", ".dat"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    disc = F.concat(F.lit("Disc"), (F.expr("p_partkey div 4") % 9).cast("string"), suffix)
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("folder"), F.when(F.col("p_partkey") % 40 == 7, "ReadMe.iso").otherwise(disc).alias("name"))
    return rules.file_kinds(files, PACK).select("entry_id", "file_kind")


_FILE_HITS = """hits AS (SELECT entry_id, r.* FROM named JOIN (VALUES ('temp', 60, 'temporary_data', '\\.tmp$', false, ''), ('photo', 50, 'personal_media', '\\.(jpg|mp3)$', false, 'contains_user_material'),
  ('mail', 50, 'documents', '(\\.eml|1.\\.jpg)$', false, ''), ('setup', 40, 'installer_download', '\\.exe$', false, ''), ('copy', 30, 'backup', '\\.(bak|zip)$', true, ''), ('sevens', 10, '', '7\\.', false, 'contains_database'))
  r(id, priority, category, re, review, trait) ON regexp_matches(low, re) UNION ALL SELECT entry_id, 'text', 20, 'documents', '', false, '' FROM named WHERE file_kind = 'document' AND size > 0)"""
_DECIDE = """top AS (SELECT entry_id, max(priority) AS p FROM hits WHERE category <> '' GROUP BY 1),
  decided AS (SELECT entry_id, count(DISTINCT category) AS n, min(category) AS one, bool_or(review) AS review FROM hits JOIN top USING (entry_id) WHERE category <> '' AND priority = p GROUP BY 1),
  result AS (SELECT n.entry_id, CASE WHEN d.n = 1 THEN one ELSE 'unknown' END AS category, CASE WHEN d.n IS NULL THEN 'no_rule_matched' WHEN d.n > 1 THEN 'conflicting_rules' ELSE 'matched' END AS reason, coalesce(d.review, false) AS review
    FROM {rows} n LEFT JOIN decided d USING (entry_id))"""
_TRIAGE = "CASE WHEN review THEN 'review' WHEN category IN ('personal_media','documents','source_project','application_user_data') THEN 'keep' WHEN category IN ('system_junk','cache','temporary_data','generated_artifacts','installer_download','application_installation') THEN 'discard' ELSE 'review' END"
_FAM = "CASE WHEN category IN ('personal_media','documents','source_project','application_user_data') THEN 'personal' WHEN category IN ('application_installation','application_configuration','os_installation','installer_download') THEN 'programs' WHEN category IN ('system_junk','cache','temporary_data','generated_artifacts') THEN 'disposable' ELSE 'containers' END"


def classified(spark, sf):
    return rules.classify_files(named(spark, sf).drop("category", "triage"), PACK.files)


@query(
    "c3_classify_file",
    inv.sql(_N, _FILE_HITS, _DECIDE.format(rows="named"))
    + f""" SELECT entry_id, category, reason, {_FAM} AS family, {_TRIAGE} AS triage,
      (SELECT list(h.id ORDER BY h.priority DESC, CASE h.id WHEN 'photo' THEN 0 ELSE 1 END) FROM hits h LEFT JOIN top t ON t.entry_id = h.entry_id WHERE h.entry_id = result.entry_id AND (h.trait <> '' OR (h.category <> '' AND h.priority = t.p))) AS rules FROM result""",
)
def c3(spark, sf):
    some = F.when(F.size("rules") > 0, F.col("rules"))
    return classified(spark, sf).select("entry_id", "category", "reason", "family", "triage", some.alias("rules"))


@query("c5_resolution", inv.sql(_N, _FILE_HITS, _DECIDE.format(rows="named")) + " SELECT reason, category, count(*) AS files FROM result GROUP BY ALL")
def c5(spark, sf):
    return classified(spark, sf).groupBy("reason", "category").agg(F.count(F.lit(1)).alias("files"))


@query("c10_recall", inv.sql(_N, _FILE_HITS, _DECIDE.format(rows="named")) + f" SELECT entry_id, category, {_TRIAGE} AS triage FROM result")
def c10(spark, sf):
    stored = classified(spark, sf).select("entry_id", F.concat("rules", F.array(F.lit("gone"))).alias("rules"))
    return rules.recall(stored.withColumnRenamed("rules", "stored"), PACK.files, "stored").select("entry_id", "category", "triage")


@query("pj12_explain", inv.sql(_N, _FILE_HITS) + " SELECT entry_id, count(*) FILTER (id = 'temp') AS scratch, count(*) FILTER (id = 'photo') AS pictures FROM hits WHERE id IN ('temp', 'photo') GROUP BY 1")
def pj12(spark, sf):
    told = classified(spark, sf).withColumn("told", rules.explained("rules", PACK.files))
    has = lambda s: F.array_contains("told", s).cast("long")
    return told.select("entry_id", has("Scratch files of programs.").alias("scratch"), has("Pictures and music.").alias("pictures")).where("scratch + pictures > 0")


@query(
    "pj10_notable",
    inv.sql(_N, _FILE_HITS)
    + f""", t AS (SELECT entry_id, bool_or(trait = 'contains_database') AS db, bool_or(trait = 'contains_user_material') AS um FROM hits GROUP BY 1)
    SELECT n.entry_id, list_slice(list_concat(list_filter([CASE WHEN db THEN 'contains_database' END, CASE WHEN um THEN 'contains_user_material' END], lambda x: x IS NOT NULL), {_SIG}), 1, 2) AS signals FROM named n LEFT JOIN t USING (entry_id)""",
)
def pj10(spark, sf):
    at = classified(spark, sf).withColumn("own", rules.name_signals(F.col("name"), PACK.signals))
    return at.select("entry_id", rules.notable_signals(F.col("traits"), F.col("own")).alias("signals"))


_FACTS = """facts AS (SELECT source_id, ancestor AS folder, source_id || ':' || ancestor AS entry_id, regexp_extract(ancestor, '[^/]*$') AS name, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (file_kind IN ('image','audio')) AS mf,
  coalesce(sum(size) FILTER (file_kind IN ('image','audio')), 0) AS mb, count(*) FILTER (low LIKE '%.eml' AND low NOT LIKE '%5.eml' AND regexp_replace(path, '/[^/]*$', '') = ancestor) AS mails, count(*) FILTER (low LIKE '%.bak' OR low LIKE '%.zip') AS copies,
  count(*) FILTER (low LIKE '%.jpg') AS indicators FROM closure GROUP BY ALL)"""
_FOLDER_HITS = """hits AS (SELECT entry_id, 'scratch' AS id, 60 AS priority, 'temporary_data' AS category, false AS review FROM facts WHERE regexp_full_match(name, '1.') AND mails = 0
  UNION ALL SELECT entry_id, 'album', 50, 'personal_media', false FROM facts WHERE mf >= 2 AND bytes > 0 AND mb >= 0.3 * bytes UNION ALL SELECT entry_id, 'archive', 50, 'backup', true FROM facts WHERE copies >= 3
  UNION ALL SELECT entry_id, 'letters', 40, 'documents', false FROM facts WHERE mails > 0)"""
_FOLDERS = inv.sql(_N, closure_sql("named"), _FACTS, _FOLDER_HITS, _DECIDE.format(rows="facts"))
_FOLDERS += f", plain AS (SELECT r.*, f.source_id, f.folder, f.indicators, {_TRIAGE} AS raw FROM result r JOIN facts f USING (entry_id))"


def folders(spark, sf):
    return rules.classify_folders(rules.folder_facts(inv.files(spark, sf), PACK.signals), PACK.folders)


_GROUPED = "category IN ('application_installation','os_installation','source_project','application_user_data','cache','generated_artifacts','backup')"


@query(
    "c4_classify_folder",
    _FOLDERS + f" SELECT source_id, folder, category, reason, {_FAM} AS family, {_GROUPED} AS grouped FROM plain",
)
def c4(spark, sf):
    return folders(spark, sf).select("source_id", "folder", "category", "reason", "family", "grouped")


@query("c8_veto", _FOLDERS + " SELECT source_id, folder, CASE WHEN raw = 'discard' AND indicators > 0 THEN 'review' ELSE raw END AS triage, raw = 'discard' AND indicators > 0 AS veto FROM plain")
def c8(spark, sf):
    return folders(spark, sf).select("source_id", "folder", "triage", "veto")


@query(
    "c9_owner",
    _FOLDERS
    + f""", owned AS (SELECT source_id, folder, indicators, raw, folder LIKE '%3' AS own, CASE WHEN folder LIKE '%3' THEN 'cache' ELSE category END AS category FROM plain),
    t AS (SELECT *, CASE WHEN own THEN 'discard' ELSE raw END AS plain_triage FROM owned)
    SELECT source_id, folder, category, {_FAM} AS family, plain_triage = 'discard' AND indicators > 0 AS veto, CASE WHEN plain_triage = 'discard' AND indicators > 0 THEN 'review' ELSE plain_triage END AS triage,
      CASE WHEN folder LIKE '%4' THEN true ELSE {_GROUPED} END AS grouped FROM t""",
)
def c9(spark, sf):
    own = folders(spark, sf).withColumns({"own_category": F.when(F.col("folder").endswith("3"), "cache"), "own_group": F.when(F.col("folder").endswith("4"), F.lit(True))})
    return rules.apply_owner(own).select("source_id", "folder", "category", "family", "veto", "triage", "grouped")


@query(
    "c11_kind_share",
    inv.sql(_N, closure_sql("named"), _FACTS)
    + " SELECT source_id, folder, CASE WHEN b = 0 THEN false ELSE m >= 0.5 * b END AS half, mf >= 1 AS some FROM (SELECT *, CASE WHEN folder LIKE '%2' THEN 0 ELSE bytes END AS b, CASE WHEN folder LIKE '%2' THEN 0 ELSE mb END AS m FROM facts)",
)
def c11(spark, sf):
    """Shares of folders, some of which are taken to have no bytes."""
    facts = rules.folder_facts(inv.files(spark, sf), PACK.signals)
    none = F.col("folder").endswith("2")
    at = lambda m: sum((F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)) for k in ("image", "audio")), F.lit(0))
    files, size, whole = at("kind_files"), F.when(none, 0).otherwise(at("kind_bytes")), F.when(none, 0).otherwise(F.col("bytes"))
    return facts.select("source_id", "folder", Share(("image", "audio"), 0, 0.5).holds(files, size, whole).alias("half"), Share(("image", "audio"), 1, 0.0).holds(files, size, whole).alias("some"))


_BY_KIND = "by_kind AS (SELECT source_id, CASE WHEN category = 'unknown' THEN ['personal_media','documents','source_project','application_user_data','application_installation','application_configuration','os_installation','installer_download','system_junk','cache','temporary_data','generated_artifacts','download_collection','backup','mixed','unknown'][1 + entry_id % 16] ELSE category END AS category FROM files)"


@query("c6_family", inv.sql(_BY_KIND, f"c AS (SELECT source_id, category, false AS review, count(*) AS files FROM by_kind GROUP BY ALL)") + f" SELECT source_id, category, files, {_FAM} AS family, {_TRIAGE} AS triage, {_GROUPED} AS grouped FROM c")
def c6(spark, sf):
    """Family, triage and group of the categories that a source's files have."""
    order = F.array(*(F.lit(c) for c in rules.FAMILY_OF))
    category = F.when(F.col("category") == "unknown", F.element_at(order, (1 + F.col("entry_id") % 16).cast("int"))).otherwise(F.col("category"))
    cats = inv.files(spark, sf).groupBy("source_id", category.alias("category")).agg(F.count(F.lit(1)).alias("files")).withColumn("indicators", F.lit(0))
    of = cats.withColumns({"family": rules.mapped(F.col("category"), rules.FAMILY_OF), "triage": F.coalesce(rules.mapped(F.col("category"), rules.TRIAGE_OF), F.lit("review"))})
    return rules.folder_flags(of).select("source_id", "category", "files", "family", "triage", "grouped")
