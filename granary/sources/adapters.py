"""File-inventory views of the driver's tables, in Spark and as SQL.

Each adapter has a DataFrame builder and a common table expression of the same
name and columns for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.runs import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Times of files, from the id and in nanoseconds; past the largest that a long can hold they begin again at 0.
#: The SQL multiplies by the id itself, which is the same up to id 23,058 and an overflow beyond.
MTIME_NS = "doc_id % 23059 * 400000000000000"


def tree_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: one per document, below source and language; content is the text's digest."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entry_id"),
        F.col("source").alias("source_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("lang").alias("kind"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("digest"),
        F.expr(MTIME_NS).alias("mtime_ns"),
        # every third and fifth file are names of one inode
        (F.col("doc_id") - F.col("doc_id") % 15).alias("ino"),
        F.when(F.col("doc_id") % 15 < 2, 2).otherwise(1).alias("nlink"),
        (F.col("doc_id") % 11 == 0).alias("unreadable"),
        F.when(F.col("doc_id") % 7 == 0, "pending").when(F.col("doc_id") % 13 == 0, "sampled").otherwise("hashed").alias("state"),
    )


TREE_DOCS = """
tree_docs AS (
  SELECT doc_id AS entry_id, source AS source_id, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         lang AS kind, n_chars AS size, sha256(text) AS digest, doc_id * 400000000000000 AS mtime_ns,
         doc_id - doc_id % 15 AS ino, CASE WHEN doc_id % 15 < 2 THEN 2 ELSE 1 END AS nlink,
         doc_id % 11 = 0 AS unreadable,
         CASE WHEN doc_id % 7 = 0 THEN 'pending' WHEN doc_id % 13 = 0 THEN 'sampled' ELSE 'hashed' END AS state
  FROM documents)"""


def tree_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-level tree: region, nation, customer, order, line."""
    t = lambda n: table(spark, sf_dir, n)
    # orders first find their customers, so that lines, of which there are most, are dealt once
    placed = (
        dealt(t("orders"), "o_custkey")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = dealt(t("lineitem"), "l_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.lower("l_returnflag"))
    return joined.select(
        F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("o"), F.col("o_orderkey")), line).alias("path"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("family"),
        F.col("l_quantity").cast("long").alias("size"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime_s"),
        F.year("l_shipdate").alias("year"),
    )


def customer_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` of the customers' folders in ``tree_orders``, and of customers without orders."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey"))).alias("path"))


TREE_ORDERS = """
tree_orders AS (
  SELECT r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey || '/' || l_linenumber || '.' || lower(l_returnflag) AS path,
         l_returnflag AS kind, l_linestatus AS family, CAST(l_quantity AS BIGINT) AS size,
         CAST(epoch(l_shipdate) AS BIGINT) AS mtime_s, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def closure_sql(tree: str, root: bool = False) -> str:
    """CTE ``closure``: the tree's rows with ``ancestor`` and ``level``."""
    low = 0 if root else 1
    return f"""
closure AS (
  SELECT t.*, CAST(l.level AS INTEGER) AS level, array_to_string(list_slice(string_split(t.path, '/'), 1, l.level), '/') AS ancestor
  FROM {tree} t, range({low}, 32) l(level) WHERE l.level < len(string_split(t.path, '/')))"""


def owner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own decisions and tags: quality gives keep or discard, toxic gives a tag."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("entry_id"),
        F.when(F.col("quality") == 1, "keep").otherwise("discard").alias("decision"),
        F.when(F.col("toxic") == 1, "flagged").alias("tag"),
    )


OWNER_LABELS = """
owner_labels AS (
  SELECT doc_id AS entry_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'discard' END AS decision,
         CASE WHEN toxic = 1 THEN 'flagged' END AS tag FROM labels)"""


def photos_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos: an event each; the camera is the user's remainder, the folder the event's day."""
    e = table(spark, sf_dir, "events")
    shift = F.when(F.col("user_id") % 7 == 3, 26 * 3600).otherwise(0)
    return e.select(
        F.col("event_id").alias("photo_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("folder"),
        F.concat(F.lit("cam"), (F.col("user_id") % 7).cast("string")).alias("camera"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + shift).alias("capture_s"),
        F.concat(F.date_format("ts", "'IMG_'yyyyMMdd'_'HHmmss"), F.lit(".jpg")).alias("name"),
        F.col("event_type").alias("kind"),
    )


PHOTOS_EVENTS = """
photos_events AS (
  SELECT event_id AS photo_id, strftime(ts, '%Y-%m-%d') AS folder, 'cam' || (user_id % 7) AS camera,
         CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN user_id % 7 = 3 THEN 93600 ELSE 0 END AS capture_s,
         'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' AS name, event_type AS kind FROM events)"""


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of lines: a document is a folder, a line a file whose content is its digest."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("folder"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).select(
        "folder", F.col("place").cast("long").alias("place"), F.md5("line").alias("key"), F.length("line").cast("long").alias("size")
    )


TREE_LINES = """
tree_lines AS (
  SELECT doc_id AS folder, CAST(g AS BIGINT) - 1 AS place, md5(parts[g]) AS key, CAST(length(parts[g]) AS BIGINT) AS size
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS g
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def archives_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: a conversation is an archive, a turn a member below its role's folder."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("archive_id"),
        F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"), F.lit(".msg")).alias("path"),
        F.length("text").cast("long").alias("size"),
        F.md5("text").alias("key"),
    )


ARCHIVES_CONV = """
archives_conv AS (
  SELECT conv_id AS archive_id, role || '/' || turn || '.msg' AS path, CAST(length(text) AS BIGINT) AS size, md5(text) AS key FROM conversations)"""


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by address: scheme, query, fragment and a last slash are taken off."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), "/+$", "")
    return p.select(F.col("page_id").alias("entry_id"), path.alias("path"), F.length("html").cast("long").alias("size"))


TREE_PAGES = r"""
tree_pages AS (
  SELECT page_id AS entry_id,
         regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path,
         CAST(length(html) AS BIGINT) AS size FROM pages)"""


def with_tables(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
