"""Decisions, tags, selections, review lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.paths import with_ancestors
from granary.operators import intent
from granary.plans.registry import query
from granary.sources import adapters as a

#: Own decisions: a source's folder keeps, some languages discard, some files undecided.
_OWN = """own AS (SELECT DISTINCT source_id AS own_path, 'keep' AS own_decision, 1 AS level FROM tree_docs WHERE source_id IN ('src1', 'src2', 'src3')
  UNION ALL SELECT DISTINCT source_id || '/' || kind, 'discard', 2 FROM tree_docs WHERE kind = 'de'
  UNION ALL SELECT path, 'undecided', 3 FROM tree_docs WHERE entry_id % 9 = 0)"""
_I = a.with_tables(
    a.TREE_DOCS,
    _OWN,
    """spots AS (SELECT path, path AS spot FROM tree_docs UNION ALL SELECT path, source_id FROM tree_docs UNION ALL SELECT path, source_id || '/' || kind FROM tree_docs)""",
    """near AS (SELECT path, own_decision, own_path FROM spots JOIN own ON spot = own.own_path QUALIFY row_number() OVER (PARTITION BY path ORDER BY level DESC) = 1)""",
    """eff AS (SELECT t.*, coalesce(n.own_decision, 'undecided') AS decision, n.own_path AS origin FROM tree_docs t LEFT JOIN near n USING (path))""",
)


def own(spark, sf):
    t = a.tree_docs(spark, sf)
    keep = t.where("source_id in ('src1', 'src2', 'src3')").select(F.col("source_id").alias("own_path"), F.lit("keep").alias("own_decision")).distinct()
    discard = t.where("kind = 'de'").select(F.concat_ws("/", "source_id", "kind").alias("own_path"), F.lit("discard").alias("own_decision")).distinct()
    back = t.where("entry_id % 9 = 0").select(F.col("path").alias("own_path"), F.lit("undecided").alias("own_decision"))
    return keep.unionByName(discard).unionByName(back)


def effective(spark, sf):
    return intent.effective_decisions(a.tree_docs(spark, sf), own(spark, sf))


@query("i1_effective", _I + " SELECT entry_id, decision, origin FROM eff")
def i1(spark, sf):
    return effective(spark, sf).select("entry_id", "decision", "origin")


@query("w6_nearest", _I + " SELECT path, own_decision, own_path FROM near")
def w6(spark, sf):
    return effective(spark, sf).where("origin is not null").select("path", F.col("decision").alias("own_decision"), F.col("origin").alias("own_path"))


@query("i2_bulk_guard", _I + " SELECT entry_id, decision = 'keep' AS skipped FROM eff WHERE kind = 'en'")
def i2(spark, sf):
    return effective(spark, sf).where("kind = 'en'").select("entry_id", (F.col("decision") == "keep").alias("skipped"))


@query(
    "a16_decision_totals",
    _I + ", e(decision) AS (VALUES ('keep'), ('discard'), ('undecided'), ('later')) SELECT e.decision, count(entry_id) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM e LEFT JOIN eff USING (decision) GROUP BY 1",
)
def a16(spark, sf):
    all_of = spark.createDataFrame([("keep",), ("discard",), ("undecided",), ("later",)], "decision string")
    t = effective(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return all_of.join(t, "decision", "left").select("decision", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


_T = a.with_tables(a.TREE_DOCS, a.OWNER_LABELS, "tagged AS (SELECT t.path, tag, 3 AS level FROM tree_docs t JOIN owner_labels USING (entry_id) WHERE tag IS NOT NULL UNION ALL SELECT DISTINCT source_id || '/fr', 'french', 2 FROM tree_docs WHERE kind = 'fr')")


@query("i4_effective_tags", _T + " SELECT d.entry_id, tag FROM tree_docs d JOIN tagged g ON g.path IN (d.path, d.source_id, d.source_id || '/' || d.kind)")
def i4(spark, sf):
    t = a.tree_docs(spark, sf).select("entry_id", "path", "source_id", "kind")
    mine = t.join(a.owner_labels(spark, sf).where("tag is not null"), "entry_id").select("entry_id", "tag")
    above = t.where("kind = 'fr'").select(F.concat_ws("/", "source_id", "kind").alias("at"), F.lit("french").alias("tag")).distinct()
    inherited = with_ancestors(t).join(above, F.col("ancestor") == F.col("at")).select("entry_id", "tag")
    return mine.unionByName(inherited).distinct()


@query("f9_tag_filter", _T + " SELECT DISTINCT d.entry_id FROM tree_docs d JOIN tagged g ON g.path IN (d.path, d.source_id || '/' || d.kind) WHERE tag = 'french'")
def f9(spark, sf):
    return i4(spark, sf).where("tag = 'french'").select("entry_id")


_OWN_TAGS = """own_tags AS (SELECT path, 'flagged' AS tag FROM tree_docs JOIN labels ON doc_id = entry_id WHERE toxic = 1
  UNION SELECT DISTINCT source_id || '/' || kind, 'french' FROM tree_docs WHERE kind = 'fr' UNION SELECT DISTINCT source_id, 'flagged' FROM tree_docs WHERE source_id LIKE '%1' UNION SELECT DISTINCT source_id, 'french' FROM tree_docs)"""


@query("w5_nearest_tag", a.with_tables(a.TREE_DOCS, _OWN_TAGS) + " SELECT d.path, tag, max(len(string_split(o.path, '/'))) AS level FROM tree_docs d JOIN own_tags o ON d.path = o.path OR starts_with(d.path, o.path || '/') GROUP BY ALL")
def w5(spark, sf):
    """Tags of files, of language folders and of sources, where a nearer carrier hides one further up."""
    t = a.tree_docs(spark, sf)
    tag = lambda rows, path, name: rows.select(path.alias("own_path"), F.lit(name).alias("tag"))
    toxic = a.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    own = tag(t.join(toxic, "entry_id", "left_semi"), F.col("path"), "flagged").unionByName(tag(t.where("kind = 'fr'"), F.concat_ws("/", "source_id", "kind"), "french"))
    own = own.unionByName(tag(t.where("source_id like '%1'"), F.col("source_id"), "flagged")).unionByName(tag(t, F.col("source_id"), "french")).distinct()
    return intent.effective_tags(t, own).withColumn("level", F.col("level").cast("long"))


@query("a25_tag_counts", _T + " SELECT tag, count(*) AS n FROM tagged GROUP BY 1")
def a25(spark, sf):
    t = a.tree_docs(spark, sf)
    mine = t.join(a.owner_labels(spark, sf).where("tag is not null"), "entry_id").select("tag")
    folders = t.where("kind = 'fr'").select("source_id").distinct().select(F.lit("french").alias("tag"))
    return mine.unionByName(folders).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("i9_ancestors", a.with_tables(a.TREE_DOCS) + " SELECT entry_id, source_id AS ancestor FROM tree_docs UNION ALL SELECT entry_id, source_id || '/' || kind FROM tree_docs")
def i9(spark, sf):
    return with_ancestors(a.tree_docs(spark, sf)).select("entry_id", "ancestor")


_SEL = a.with_tables(a.TREE_DOCS, "picked AS (SELECT DISTINCT source_id AS path FROM tree_docs WHERE source_id LIKE 'src1%' UNION SELECT source_id || '/' || kind FROM tree_docs WHERE kind = 'es' UNION SELECT path FROM tree_docs WHERE entry_id % 5 = 0)")
_TOP = _SEL + ", tops AS (SELECT path FROM picked p WHERE NOT EXISTS (SELECT 1 FROM picked q WHERE p.path LIKE q.path || '/%'))"


def picked(spark, sf):
    t = a.tree_docs(spark, sf)
    return (
        t.where("source_id like 'src1%'").select(F.col("source_id").alias("path"))
        .unionByName(t.where("kind = 'es'").select(F.concat_ws("/", "source_id", "kind").alias("path")))
        .unionByName(t.where("entry_id % 5 = 0").select("path"))
        .distinct()
    )


@query("d11_outermost", _TOP + " SELECT path FROM tops")
def d11(spark, sf):
    return intent.topmost(picked(spark, sf))


@query("x9_topmost", _TOP + " SELECT t.path, count(*) AS files, CAST(sum(d.size) AS BIGINT) AS bytes FROM tops t JOIN tree_docs d ON d.path = t.path OR d.path LIKE t.path || '/%' GROUP BY 1")
def x9(spark, sf):
    t = a.tree_docs(spark, sf)
    tops = intent.topmost(picked(spark, sf)).withColumnRenamed("path", "top")
    rows = with_ancestors(t.select("path", "size")).select("ancestor", "size").unionByName(t.select(F.col("path").alias("ancestor"), "size"))
    return rows.join(tops, F.col("ancestor") == F.col("top")).groupBy(F.col("top").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("a26_selection", _TOP + " SELECT count(DISTINCT d.path) AS files, CAST(sum(d.size) AS BIGINT) AS bytes FROM tops t JOIN tree_docs d ON d.path = t.path OR d.path LIKE t.path || '/%'")
def a26(spark, sf):
    return x9(spark, sf).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query("d16_open", _I + " SELECT entry_id, decision = 'undecided' AS is_open FROM eff WHERE state = 'hashed'")
def d16(spark, sf):
    return effective(spark, sf).where("state = 'hashed'").select("entry_id", (F.col("decision") == "undecided").alias("is_open"))


@query("a22_summary", _I + " SELECT decision, state, count(*) AS n, count(*) FILTER (unreadable) AS unreadable FROM eff GROUP BY ALL")
def a22(spark, sf):
    return effective(spark, sf).groupBy("decision", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if("unreadable").alias("unreadable"))


@query("a24_state_counts", a.with_tables(a.TREE_DOCS) + " SELECT count(*) AS all_rows, count(*) FILTER (state = 'hashed') AS hashed, count(*) FILTER (state <> 'hashed') AS other FROM tree_docs")
def a24(spark, sf):
    return a.tree_docs(spark, sf).agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(F.col("state") == "hashed").alias("hashed"), F.count_if(F.col("state") != "hashed").alias("other"))


@query("w3_heads", "SELECT user_id % 5 AS claim, event_type AS kind, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) = 1")
def w3(spark, sf):
    e = a.table(spark, sf, "events")
    first = e.groupBy((F.col("user_id") % 5).alias("claim"), F.col("event_type").alias("kind")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("claim", "kind", F.col("f.event_id").alias("event_id"))


_RESCUE = a.with_tables(a.TREE_ORDERS, a.closure_sql("tree_orders")) + """,
  g AS MATERIALIZED (SELECT DISTINCT ancestor AS path FROM closure WHERE (level = 3 AND family = 'O') OR (level = 2 AND ancestor LIKE 'ASIA/%')),
  ind AS (SELECT ancestor AS path, CAST(sum(size) AS BIGINT) AS bytes FROM closure WHERE level = 4 GROUP BY 1 HAVING max(size) = 50 UNION ALL SELECT path, size FROM tree_orders WHERE kind = 'R'),
  up AS (SELECT path, bytes, string_split(path, '/') AS p FROM ind),
  spots AS MATERIALIZED (SELECT path, bytes, array_to_string(p[1:k], '/') AS up, k FROM up, range(1, 5) r(k) WHERE k < len(p)),
  ins AS MATERIALIZED (SELECT spots.path, bytes, arg_min(spots.up, k) AS group_path FROM spots JOIN g ON g.path = spots.up GROUP BY ALL)"""


@query(
    "d15_rescue",
    _RESCUE
    + """, inner_ins AS MATERIALIZED (SELECT path FROM ins), covered AS MATERIALIZED (SELECT DISTINCT s.path FROM (SELECT path, up FROM spots WHERE path IN (SELECT path FROM inner_ins)) s JOIN inner_ins o ON o.path = s.up)
    SELECT i.group_path, i.path, i.bytes FROM ins i LEFT JOIN covered c USING (path) WHERE c.path IS NULL""",
)
def d15(spark, sf):
    t = a.tree_orders(spark, sf)
    c = with_ancestors(t)
    groups = c.where("(level = 3 and family = 'O') or (level = 2 and ancestor like 'ASIA/%')").select(F.col("ancestor").alias("path")).distinct()
    orders = c.where("level = 4").groupBy(F.col("ancestor").alias("path")).agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).where("most = 50").drop("most")
    return intent.rescue(orders.unionByName(t.where("kind = 'R'").select("path", F.col("size").alias("bytes"))), groups)
