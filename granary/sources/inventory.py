"""A full inventory over ``documents``: files with state, content state and links, archives and their members.

Everything but text, source, language and size is made from the document's id,
so that every state occurs; operators take the columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.adapters import MTIME_NS, table

#: Extension, file kind and category by the remainder of the id modulo 8.
SORTS = (
    (".jpg", "image", "unknown"),
    (".txt", "document", "unknown"),
    (".tmp", "system", "temporary_data"),
    (".exe", "executable", "application_installation"),
    (".MP3", "audio", "unknown"),
    (".eml", "other", "unknown"),
    ("", "other", "unknown"),
    (".bak", "other", "backup"),
)

_ID = "doc_id"
_SORT = "CASE WHEN doc_id % 40 = 0 THEN '{0}' " + " ".join(f"WHEN doc_id % 8 = {k} THEN '{{{k + 1}}}'" for k in range(8)) + " END"


def _by_sort(column: int, archive: str) -> str:
    return _SORT.format(archive, *(s[column] for s in SORTS))


#: Column expressions that Spark and DuckDB read alike; of ``mtime_ns`` Spark reads MTIME_NS.
_COLUMNS = {
    "entry_id": "doc_id",
    "source_id": "source",
    "stable": "ascii(substr(source, length(source), 1)) % 2 = 0",
    "online": "ascii(substr(source, length(source), 1)) % 3 <> 0",
    "quarantined": "doc_id % 61 = 5",
    "path": "CASE WHEN doc_id % 61 = 5 THEN '.quarantine/' ELSE '' END || lang || '/' || CAST(doc_id % 12 AS {text}) || '/' || CAST(doc_id AS {text}) || " + _by_sort(0, ".zip"),
    "file_kind": _by_sort(1, "archive"),
    "category": _by_sort(2, "unknown"),
    "triage": "CASE WHEN doc_id % 8 IN (2, 3) AND doc_id % 5 <> 0 THEN 'discard' ELSE 'review' END",
    "state": "CASE WHEN doc_id % 53 = 3 THEN 'missing' WHEN doc_id % 47 = 4 THEN 'unreadable' ELSE 'present' END",
    "size": "CASE WHEN doc_id % 97 = 6 THEN 0 ELSE n_chars END",
    "content_state": "CASE WHEN doc_id % 97 = 6 OR doc_id % 31 = 6 THEN NULL WHEN doc_id % 7 = 1 THEN 'pending' WHEN doc_id % 13 = 2 THEN 'sampled'"
    " WHEN doc_id % 17 = 3 THEN 'changed' WHEN doc_id % 19 = 4 THEN 'unreadable' WHEN doc_id % 29 = 5 THEN 'unique_size' ELSE 'hashed' END",
    "sample": "CASE WHEN doc_id % 3 = 0 THEN md5(text) END",
    "dev": "1",
    "ino": "doc_id - doc_id % 15",
    "nlink": "CASE WHEN doc_id % 15 < 2 THEN 2 ELSE 1 END",
    "mtime_ns": "doc_id * 400000000000000",
}
_MEMBER = {
    "member_id": "doc_id",
    "archive_id": "doc_id - doc_id % 40",
    "path": "'in/' || CAST(doc_id AS {text}) || '.txt'",
    "link_path": "CASE WHEN doc_id % 12 = 1 AND doc_id % 40 >= 5 THEN 'in/' || CAST(doc_id - 4 AS {text}) || '.txt' END",
    "raw_size": "CASE WHEN doc_id % 12 = 1 AND doc_id % 40 >= 5 THEN 0 ELSE n_chars END",
    "raw_state": "CASE WHEN doc_id % 12 = 1 AND doc_id % 40 >= 5 THEN NULL WHEN doc_id % 28 = 1 THEN 'pending' ELSE 'hashed' END",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file; ``digest`` only where its content state is hashed."""
    d = table(spark, sf_dir, "documents")
    own = _COLUMNS | {"mtime_ns": MTIME_NS}
    out = d.select(*(F.expr(e.format(text="string")).alias(c) for c, e in own.items()), F.sha2("text", 256).alias("digest"))
    return out.withColumn("digest", F.when(F.col("content_state") == "hashed", F.col("digest")))


#: Folders (source_id, path) that were read in part or begin another volume.
PARTIAL_SQL = "partial_folders AS (SELECT DISTINCT source_id, regexp_replace(path, '/[^/]*$', '') AS path FROM files WHERE path LIKE 'fr/3/%' AND source_id LIKE '%4' UNION SELECT DISTINCT source_id, 'es' FROM files WHERE source_id LIKE '%7')"


def partial_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("source_id", "path")
    mounts = f.where("path like 'fr/3/%' and source_id like '%4'").select("source_id", F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return mounts.unionByName(f.where("source_id like '%7'").select("source_id", F.lit("es").alias("path"))).distinct()


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as listed: a tar hard link names its target's path and has no content of its own."""
    d = table(spark, sf_dir, "documents").where("doc_id % 4 = 1")
    out = d.select(*(F.expr(e.format(text="string")).alias(c) for c, e in _MEMBER.items()), F.sha2("text", 256).alias("raw_digest"))
    return out.withColumn("raw_digest", F.when(F.col("raw_state") == "hashed", F.col("raw_digest")))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed archives: their entry and the state of the listing."""
    d = table(spark, sf_dir, "documents").where("doc_id % 40 = 0")
    return d.select(F.col("doc_id").alias("archive_id"), F.when(F.col("doc_id") % 200 == 120, "failed").otherwise("complete").alias("listing"))


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in columns.items())


#: The same tables as common table expressions; ``members`` has links resolved.
SQL = f"""
all_files AS (SELECT {_sql(_COLUMNS)}, sha256(text) AS text_digest FROM documents),
files AS (SELECT * EXCLUDE (text_digest), CASE WHEN content_state = 'hashed' THEN text_digest END AS digest FROM all_files),
raw_members AS (SELECT {_sql(_MEMBER)}, CASE WHEN NOT (doc_id % 12 = 1 AND doc_id % 40 >= 5) AND doc_id % 28 <> 1 THEN sha256(text) END AS raw_digest FROM documents WHERE doc_id % 4 = 1),
archives AS (SELECT doc_id AS archive_id, CASE WHEN doc_id % 200 = 120 THEN 'failed' ELSE 'complete' END AS listing FROM documents WHERE doc_id % 40 = 0),
members AS (SELECT m.member_id, m.archive_id, m.path, m.link_path, coalesce(t.raw_size, m.raw_size) AS size, CASE WHEN m.link_path IS NULL THEN m.raw_state ELSE t.raw_state END AS content_state,
            CASE WHEN m.link_path IS NULL THEN m.raw_digest ELSE t.raw_digest END AS digest FROM raw_members m LEFT JOIN raw_members t ON t.archive_id = m.archive_id AND t.path = m.link_path)"""

_PHYS = "CASE WHEN {0}.nlink > 1 AND {0}.ino IS NOT NULL AND {0}.dev IS NOT NULL AND {0}.stable THEN 'h' || {0}.source_id || '/' || {0}.dev || '/' || {0}.ino ELSE 'e' || {0}.entry_id END"
#: ``copy``: each name of a physical copy of a content, in files and in complete archives.
COPY_SQL = f"""
copy AS (
  SELECT f.digest, f.size, false AS member, f.entry_id AS id, f.entry_id AS holder, f.source_id, f.online, f.path AS at_path, {_PHYS.format("f")} AS pkey
  FROM files f WHERE f.content_state = 'hashed' AND f.state = 'present' AND NOT f.quarantined
  UNION ALL
  SELECT m.digest, m.size, true, m.member_id, f.entry_id, f.source_id, f.online, f.path, 'm' || {_PHYS.format("f")} || '/' || coalesce(m.link_path, m.path)
  FROM members m JOIN archives a ON a.archive_id = m.archive_id JOIN files f ON f.entry_id = m.archive_id
  WHERE m.content_state = 'hashed' AND a.listing = 'complete' AND f.state = 'present' AND NOT f.quarantined)"""


def sql(*more: str) -> str:
    return "WITH " + ",".join([SQL, COPY_SQL, *more])
