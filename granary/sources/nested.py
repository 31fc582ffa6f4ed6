"""A nested tree over ``documents``: source, language, document, a folder per four lines, and a file per line.

Every tenth document is a complete archive whose members are its lines.  Some
lines are not read yet, some are alone by size or sample, some are names of one
inode, and some folders are not readable, so that gaps and hard links occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.adapters import table

#: Expressions that Spark and DuckDB read alike, over doc_id, source, lang, place (from 0), line and key.
_LINE = {
    "source_id": "source",
    "archive": "CASE WHEN doc_id % 10 = 7 THEN lang || '/' || CAST(doc_id AS {text}) || '.zip' END",
    "path": "lang || '/' || CAST(doc_id AS {text}) || CASE WHEN doc_id % 10 = 7 THEN '.zip' ELSE '' END || '/p' || CAST((place - place % 4) AS {text}) || '/' || CAST(place AS {text})",
    "content_state": "CASE WHEN (doc_id * 31 + place) % 211 = 5 THEN 'pending' WHEN (doc_id * 31 + place) % 197 = 3 THEN 'sampled' ELSE 'hashed' END",
    "digest": "CASE WHEN (doc_id * 31 + place) % 211 = 5 OR (doc_id * 31 + place) % 197 = 3 THEN NULL ELSE key END",
    "stable": "ascii(substr(source, length(source), 1)) % 2 = 0",
    "dev": "1",
    "ino": "CASE WHEN doc_id % 6 = 5 THEN substr(key, 1, 12) ELSE CAST(doc_id AS {text}) || '-' || CAST(place AS {text}) END",
    "nlink": "CASE WHEN doc_id % 6 = 5 THEN 2 ELSE 1 END",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line; ``archive`` is the path of the archive that holds it as a member, or null."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = lines.withColumn("place", F.col("place").cast("long")).withColumn("key", F.md5("line"))
    return keyed.select(*(F.expr(e.format(text="string")).alias(c) for c, e in _LINE.items()), F.octet_length("line").cast("long").alias("size"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_text"))


def folder_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that could not be read or begin another mount."""
    d = table(spark, sf_dir, "documents").where("doc_id % 41 = 6 and doc_id % 10 <> 7")
    return d.select(F.col("source").alias("source_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete archives with their packed size."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 = 7")
    return d.select(F.col("source").alias("source_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), F.expr("n_chars div 2 + 1").alias("packed"))


_COLUMNS = ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _LINE.items())
SQL = f"""
lines AS (SELECT doc_id, source, lang, CAST(g AS BIGINT) - 1 AS place, parts[g] AS line, md5(parts[g]) AS key
  FROM (SELECT doc_id, source, lang, parts, unnest(range(1, len(parts) + 1)) AS g FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))),
line_files AS (SELECT {_COLUMNS}, CAST(strlen(line) AS BIGINT) AS size FROM lines),
folder_gaps AS (SELECT source AS source_id, lang || '/' || doc_id AS path FROM documents WHERE doc_id % 41 = 6 AND doc_id % 10 <> 7),
line_archives AS (SELECT source AS source_id, lang || '/' || doc_id || '.zip' AS path, n_chars // 2 + 1 AS packed FROM documents WHERE doc_id % 10 = 7)"""
