"""Snapshots, plans, commands, streaming ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions.paths import parent, with_ancestors
from granary.operators import changes
from granary.plans.inventory_queries import tables
from granary.plans.registry import query
from granary.plans.tree_queries import _ENTRIES, entries
from granary.sources import adapters as a
from granary.sources import inventory as inv
from granary.streaming import ingest

_D = a.with_tables(a.TREE_DOCS)
_SNAP = a.with_tables(
    a.TREE_DOCS,
    "old AS (SELECT path, kind, size, mtime_ns FROM tree_docs WHERE entry_id % 10 <> 0)",
    "new AS (SELECT path, CASE WHEN entry_id % 17 = 0 THEN 'dir' ELSE kind END AS kind, size, mtime_ns + CASE WHEN entry_id % 4 = 0 THEN 3600000000000 WHEN entry_id % 6 = 0 THEN 5000000000 ELSE 0 END AS mtime_ns FROM tree_docs WHERE entry_id % 9 <> 0)",
    "d AS (SELECT path, o.kind AS ok, n.kind AS nk, o.size AS os, n.size AS ns, abs(n.mtime_ns - o.mtime_ns) AS dt FROM old o FULL OUTER JOIN new n USING (path))",
    "ops AS (SELECT path, CASE WHEN ok IS NULL THEN 'insert' WHEN nk IS NULL THEN 'missing' WHEN nk <> ok THEN 'replace' WHEN os = ns AND (dt <= 2000000000 OR abs(dt - 3600000000000) <= 2000000000) THEN 'unchanged' ELSE 'update' END AS op FROM d)",
)


def snapshots(spark, sf):
    t = a.tree_docs(spark, sf)
    shift = F.when(F.col("entry_id") % 4 == 0, 3_600_000_000_000).when(F.col("entry_id") % 6 == 0, 5_000_000_000).otherwise(0)
    new = t.where("entry_id % 9 <> 0").select("path", F.when(F.col("entry_id") % 17 == 0, "dir").otherwise(F.col("kind")).alias("kind"), "size", (F.col("mtime_ns") + shift).alias("mtime_ns"))
    return t.where("entry_id % 10 <> 0").select("path", "kind", "size", "mtime_ns"), new


@query("s3_diff", _SNAP + " SELECT path, op FROM ops")
def s3(spark, sf):
    return changes.snapshot_diff(*snapshots(spark, sf), resolution=2_000_000_000, local_time=True)


@query("s5_missing", _SNAP + " SELECT path FROM ops WHERE op = 'missing'")
def s5(spark, sf):
    old, new = snapshots(spark, sf)
    return old.join(new, "path", "left_anti").select("path")


@query("x18_first_difference", _SNAP + " SELECT min(path) AS path FROM ops WHERE op <> 'unchanged'")
def x18(spark, sf):
    return s3(spark, sf).where("op <> 'unchanged'").agg(F.min("path").alias("path"))


@query("t3_figure_diff", _SNAP + " SELECT op, count(*) AS n FROM ops WHERE op <> 'unchanged' GROUP BY 1")
def t3(spark, sf):
    return s3(spark, sf).where("op <> 'unchanged'").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("s16_command_log", "SELECT user_id AS command_key, min(event_id) AS first_id, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY 1")
def s16(spark, sf):
    return a.table(spark, sf, "events").groupBy(F.col("user_id").alias("command_key")).agg(F.min("event_id").alias("first_id"), (F.count_distinct("props") > 1).alias("conflict"))


#: Where each file and folder of the inventory is to go: back where it is, into itself, to the top, or to another folder.
_WISH = """wish AS (SELECT *, CASE WHEN path LIKE '%1' THEN 'src1' ELSE source_id END AS plan_source, CASE length(path) % 5 WHEN 0 THEN regexp_replace(path, '/?[^/]*$', '') WHEN 1 THEN path || '/x' WHEN 2 THEN '' ELSE 'en/3' END AS dest,
  CASE WHEN length(path) % 5 = 2 AND kind = 'directory' THEN '.quarantine' ELSE regexp_extract(path, '[^/]*$') END AS name, CASE WHEN length(path) % 3 = 0 THEN 'keep' ELSE 'undecided' END AS effective,
  CASE WHEN length(path) % 2 = 0 THEN 'keep' END AS decision, 'undecided' AS dest_effective, (SELECT count(*) FROM entries m WHERE m.mount AND m.source_id = e.source_id AND starts_with(m.path, e.path || '/')) AS mounts FROM entries e)"""


@query(
    "x1_refusal",
    inv.sql(_ENTRIES, _WISH)
    + """ SELECT source_id, path, kind, CASE WHEN source_id <> plan_source THEN 'other_source' WHEN path = '.quarantine' OR starts_with(path, '.quarantine/') THEN 'in_quarantine' WHEN state = 'missing' THEN 'missing' WHEN path = '' THEN 'source_root'
      WHEN mount THEN 'other_filesystem' WHEN kind = 'directory' AND mounts > 0 THEN 'contains_mount' WHEN kind = 'directory' AND (dest = path OR starts_with(dest, path || '/')) THEN 'into_itself'
      WHEN dest = regexp_replace(path, '/?[^/]*$', '') AND name = regexp_extract(path, '[^/]*$') THEN 'already_there' WHEN dest = '' AND name = '.quarantine' THEN 'reserved_name'
      WHEN effective = 'keep' AND decision IS NULL AND dest_effective <> effective THEN 'would_lose_keep' END AS reason FROM wish""",
)
def x1(spark, sf):
    rows = entries(spark, sf)
    path, last = F.col("path"), F.substring_index("path", "/", -1)
    rest = F.length("path") % 5
    mounts = with_ancestors(rows.where("mount")).groupBy("source_id", F.col("ancestor").alias("path")).agg(F.count(F.lit(1)).alias("mounts"))
    wish = rows.join(mounts, ["source_id", "path"], "left").withColumns(
        {
            "mounts": F.coalesce("mounts", F.lit(0)), "plan_source": F.when(path.endswith("1"), "src1").otherwise(F.col("source_id")),
            "dest": F.when(rest == 0, parent(path)).when(rest == 1, F.concat(path, F.lit("/x"))).when(rest == 2, "").otherwise("en/3"),
            "name": F.when((rest == 2) & (F.col("kind") == "directory"), ".quarantine").otherwise(last), "effective": F.when(F.length("path") % 3 == 0, "keep").otherwise("undecided"),
            "decision": F.when(F.length("path") % 2 == 0, "keep"), "dest_effective": F.lit("undecided"),
        }
    )
    return wish.select("source_id", "path", "kind", changes.refusal(bulk=True).alias("reason"))


@query("x2_conflict", "SELECT p_partkey AS seq, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) > 1 AS conflict FROM part")
def x2(spark, sf):
    moves = a.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("dest"), F.col("p_type").alias("name"))
    return changes.name_conflicts(moves, True).select("seq", "conflict")


#: Parts moved into their brand's folder, named by type with a number here and there; suppliers' names are there already.
_MOVES = """moves AS (SELECT p_partkey AS entry_id, p_brand AS dest, CASE WHEN p_partkey % 11 = 3 THEN p_type || ' (' || (1 + p_size % 4) || ').jpg' ELSE p_type || '.jpg' END AS name, CASE WHEN p_partkey % 4 = 1 THEN p_name END AS digest FROM part),
there AS (SELECT DISTINCT p_brand AS dest, p_type || ' (' || (1 + p_size % 7) || ').jpg' AS name, NULL AS digest FROM part WHERE p_size % 5 = 2 UNION SELECT DISTINCT p_brand, p_type || '.jpg', NULL FROM part WHERE p_size % 13 = 4
  UNION SELECT p_brand, p_type || '.jpg', min(p_name) FROM part WHERE p_size % 17 = 5 GROUP BY ALL)"""


def _moves(spark, sf):
    p = a.table(spark, sf, "part")
    wide = F.concat("p_type", F.lit(" ("), (1 + F.col("p_size") % 4).cast("string"), F.lit(").jpg"))
    plain = F.concat("p_type", F.lit(".jpg"))
    moves = p.select(
        F.col("p_partkey").alias("entry_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("dest"), F.when(F.col("p_partkey") % 11 == 3, wide).otherwise(plain).alias("name"),
        F.when(F.col("p_partkey") % 4 == 1, F.col("p_name")).alias("digest"),
    )
    none = F.lit(None).cast("string").alias("digest")
    used = p.where("p_size % 5 = 2").select(F.col("p_brand").alias("dest"), F.concat("p_type", F.lit(" ("), (1 + F.col("p_size") % 7).cast("string"), F.lit(").jpg")).alias("name"), none)
    used = used.unionByName(p.where("p_size % 13 = 4").select(F.col("p_brand").alias("dest"), plain.alias("name"), none))
    same = p.where("p_size % 17 = 5").groupBy(F.col("p_brand").alias("dest"), plain.alias("name")).agg(F.min("p_name").alias("digest"))
    return moves, used.unionByName(same)


@query(
    "x5_free_name",
    f"""WITH {_MOVES},
    turned AS (SELECT m.*, row_number() OVER w AS turn, first_value(digest) OVER w AS first_digest, EXISTS (SELECT 1 FROM there t WHERE t.dest = m.dest AND t.name = m.name) AS there,
      (SELECT max(digest) FROM there t WHERE t.dest = m.dest AND t.name = m.name) AS there_digest FROM moves m WINDOW w AS (PARTITION BY dest, name ORDER BY entry_id)),
    judged AS (SELECT *, NOT there AND turn = 1 AS keeps, NOT (NOT there AND turn = 1) AND coalesce(digest = CASE WHEN there THEN there_digest ELSE first_digest END, false) AS copied, substr(name, 1, length(name) - 4) AS stem FROM turned),
    seek AS (SELECT *, row_number() OVER (PARTITION BY dest, stem ORDER BY entry_id) AS nth FROM judged WHERE NOT keeps AND NOT copied),
    used AS (SELECT dest, name FROM moves UNION SELECT dest, name FROM there),
    free AS (SELECT s.dest, s.stem, g AS k, row_number() OVER (PARTITION BY s.dest, s.stem ORDER BY g) AS nth FROM (SELECT DISTINCT dest, stem FROM seek) s, range(1, 1000) t(g)
      WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.dest = s.dest AND u.name = s.stem || ' (' || g || ').jpg'))
    SELECT j.entry_id, CASE WHEN j.keeps THEN j.name WHEN k IS NOT NULL THEN j.stem || ' (' || k || ').jpg' END AS free_name, CASE WHEN j.copied THEN 'identical_copy' WHEN NOT j.keeps AND k IS NULL THEN 'name_taken' END AS reason
    FROM judged j LEFT JOIN seek s USING (entry_id) LEFT JOIN free f ON f.dest = s.dest AND f.stem = s.stem AND f.nth = s.nth""",
)
def x5(spark, sf):
    return changes.free_names(*_moves(spark, sf))


@query("x8_undo", "SELECT o_custkey AS action, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS step FROM orders")
def x8(spark, sf):
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).cast("long")
    return a.table(spark, sf, "orders").select(F.col("o_custkey").alias("action"), F.col("o_orderkey").alias("item"), step.alias("step"))


_GONE = "(starts_with(f.path, 'de/') OR starts_with(f.path, 'fr/') OR f.entry_id % 2 = 1)"


@query(
    "x10_last_copy",
    inv.sql(
        f"gone AS (SELECT entry_id, source_id, path FROM files f WHERE {_GONE})",
        "stays AS (SELECT digest FROM copy WHERE holder NOT IN (SELECT entry_id FROM gone))",
        "foremost AS (SELECT c.digest, c.id FROM copy c JOIN gone g ON g.entry_id = c.id WHERE NOT c.member QUALIFY row_number() OVER (PARTITION BY digest ORDER BY at_path DESC, c.source_id DESC, c.id DESC) = 1)",
    )
    + " SELECT entry_id, entry_id IN (SELECT id FROM foremost WHERE digest NOT IN (SELECT digest FROM stays)) AS refused FROM gone",
)
def x10(spark, sf):
    files, _, copy = tables(spark, sf)
    return changes.last_copies(files.alias("f").where(_GONE.replace("starts_with", "startswith")).select("entry_id", "source_id", "path"), copy)


_STEMS = """pf AS (SELECT p_partkey AS entry_id, p_brand AS folder, CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END || ['.jpg', '.xmp', '.mov', ''][1 + p_size % 4] AS name, 'y' || p_size % 3 AS dest FROM part),
mv AS (SELECT * FROM pf WHERE entry_id % 3 = 0), st AS (SELECT *, lower(regexp_replace(name, '(.)\\.[^.]*$', '\\1')) AS stem FROM pf)"""


@query("x20_siblings", f"WITH {_STEMS} SELECT m.entry_id, count(*) AS left FROM st m JOIN st o ON o.folder = m.folder AND o.stem = m.stem AND o.entry_id <> m.entry_id WHERE m.entry_id IN (SELECT entry_id FROM mv) AND NOT (o.entry_id IN (SELECT entry_id FROM mv) AND o.dest = m.dest) GROUP BY 1")
def x20(spark, sf):
    """Parts by brand and type with one of four endings; every third moves."""
    stem = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    ending = F.element_at(F.array(*(F.lit(e) for e in (".jpg", ".xmp", ".mov", ""))), 1 + F.col("p_size") % 4)
    files = a.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("folder"), F.concat(stem, ending).alias("name"), F.concat(F.lit("y"), (F.col("p_size") % 3).cast("string")).alias("dest"))
    return changes.siblings_left(files.where("entry_id % 3 = 0"), files)


_PLAN = """plan AS (SELECT DISTINCT o_custkey * 1000000000 AS seq, 'mkdir' AS op, 'c' || o_custkey AS path, 'planned' AS state FROM orders
  UNION ALL SELECT DISTINCT o_custkey * 1000000000 + 1 + ascii(o_orderstatus), 'mkdir', 'c' || o_custkey || '/' || o_orderstatus, 'planned' FROM orders
  UNION ALL SELECT o_custkey * 1000000000 + 1000 + o_orderkey, 'rename', 'c' || o_custkey || '/' || o_orderstatus || '/' || o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'planned' ELSE 'conflict' END FROM orders),
kept AS (SELECT * FROM plan p WHERE op = 'rename' OR EXISTS (SELECT 1 FROM plan m WHERE m.op = 'rename' AND m.state = 'planned' AND starts_with(m.path, p.path || '/')))"""


@query("x21_renumber", f"WITH {_PLAN} SELECT op, path, state, seq AS was, row_number() OVER (ORDER BY seq) AS seq FROM kept")
def x21(spark, sf):
    """A folder per customer and per state of its orders, and the orders that move into them or cannot."""
    o = a.table(spark, sf, "orders")
    base, customer = F.col("o_custkey") * 1_000_000_000, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    status = F.concat_ws("/", customer, "o_orderstatus")
    planned = F.lit("planned").alias("state")
    made = o.select(base.alias("seq"), F.lit("mkdir").alias("op"), customer.alias("path"), planned).distinct()
    made = made.unionByName(o.select((base + 1 + F.ascii("o_orderstatus")).alias("seq"), F.lit("mkdir").alias("op"), status.alias("path"), planned).distinct())
    state = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0), "planned").otherwise("conflict")
    moved = o.select((base + 1000 + F.col("o_orderkey")).alias("seq"), F.lit("rename").alias("op"), F.concat_ws("/", status, F.col("o_orderkey").cast("string")).alias("path"), state.alias("state"))
    return changes.drop_unused_folders(made.unionByName(moved)).withColumn("seq", F.col("seq").cast("long"))


@query("t2_distinct", _D + " SELECT source_id FROM tree_docs WHERE kind = 'de' UNION SELECT source_id FROM tree_docs WHERE size > 9000")
def t2(spark, sf):
    t = a.tree_docs(spark, sf)
    return t.where("kind = 'de'").select("source_id").union(t.where("size > 9000").select("source_id")).distinct()


@query("t6_adjust", _D + " SELECT kind, CAST(sum(CASE WHEN entry_id % 2 = 0 THEN size ELSE -size END) AS BIGINT) AS delta FROM tree_docs GROUP BY 1")
def t6(spark, sf):
    return a.tree_docs(spark, sf).groupBy("kind").agg(F.sum(F.when(F.col("entry_id") % 2 == 0, F.col("size")).otherwise(-F.col("size"))).alias("delta"))


@query("t12_expired", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' AND event_type = 'click'")
def t12(spark, sf):
    return a.table(spark, sf, "events").where("ts < timestamp_ntz'2024-01-10 00:00:00' and event_type = 'click'").select("event_id")


_ROOTS = """roots AS (SELECT DISTINCT entry_id % 2 AS volume, array_to_string(string_split(path, '/')[: 1 + entry_id % 3], '/') AS path FROM tree_pages)"""


@query("s17_overlapping_roots", a.with_tables(a.TREE_PAGES, _ROOTS) + " SELECT x.volume, x.path AS outer_path, y.path AS inner_path FROM roots x JOIN roots y ON y.volume = x.volume AND starts_with(y.path, x.path || '/')")
def s17(spark, sf):
    """Roots are hosts, their folders and pages, on one of two volumes."""
    cut = F.call_function("substring_index", F.col("path"), F.lit("/"), (1 + F.col("entry_id") % 3).cast("int"))
    return changes.overlapping_roots(a.tree_pages(spark, sf).select((F.col("entry_id") % 2).alias("volume"), cut.alias("path")), ["volume"])


@query(
    "t4_stream_ingest",
    """WITH ops AS (SELECT user_id AS c_custkey, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, event_id, value, event_type FROM events WHERE event_type <> 'view' OR event_id % 3 = 0),
    per AS (SELECT c_custkey, bool_or(op = 'delete') AS gone, max(event_id) FILTER (op = 'insert') AS new_id, arg_max(value, event_id) FILTER (op = 'insert') AS new_value, arg_max(value, event_id) FILTER (op = 'update') AS value FROM ops GROUP BY 1)
    SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, coalesce(p.value, p.new_value, c_acctbal) AS c_acctbal, CASE WHEN new_id IS NOT NULL THEN 'signup' ELSE c_mktsegment END AS c_mktsegment
    FROM customer c FULL OUTER JOIN per p USING (c_custkey) WHERE new_id IS NOT NULL OR (c.c_custkey IS NOT NULL AND NOT coalesce(gone, false))""",
)
def t4(spark, sf):
    """Customers, changed by a stream of events: purchases take one out, sign-ups put one in, the others change a balance."""
    schema = StructType.fromDDL("c_custkey long, c_acctbal double, c_mktsegment string")
    root, state = ingest.shared_folder(spark, "customers"), ingest.shared_folder(spark, "customers-state")
    base = a.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    ingest.commit(root, base.withColumns({"op": F.lit("insert"), "seq": F.lit(0).cast("long")}), 0, schema, "c_custkey")
    events = spark.readStream.schema(a.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    changes_ = events.where("event_type <> 'view' or event_id % 3 = 0").select(
        F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), F.when(op == "insert", F.lit("signup")).alias("c_mktsegment"), op.alias("op"), F.col("event_id").alias("seq")
    )
    ingest.ingest(changes_, root, state, schema, "c_custkey")
    return ingest.current(spark, root, schema)


_MERGE = a.with_tables(
    a.TREE_DOCS,
    "here AS (SELECT source_id || '/' || kind || '/' || (entry_id % 39) AS path FROM tree_docs WHERE entry_id % 2 = 0)",
    "there AS (SELECT source_id || '/' || kind || '/' || (entry_id % 39) AS path FROM tree_docs WHERE entry_id % 2 = 1 AND kind <> 'fr')",
    "m AS (SELECT DISTINCT path, path IN (SELECT path FROM there) AS taken FROM here)",
    "up AS (SELECT path, string_split(path, '/') AS p FROM m WHERE NOT taken)",
    "tu AS (SELECT string_split(path, '/') AS p FROM there)",
    "made AS (SELECT p[1] AS path, 1 AS level FROM up UNION SELECT p[1] || '/' || p[2], 2 FROM up)",
    "had AS (SELECT p[1] AS path FROM tu UNION SELECT p[1] || '/' || p[2] FROM tu)",
)


@query("x4_merge", _MERGE + " SELECT 'mkdir' AS op, path, CAST(level AS INTEGER) AS level FROM made WHERE path NOT IN (SELECT path FROM had) UNION ALL SELECT CASE WHEN taken THEN 'conflict' ELSE 'rename' END, path, 3 FROM m")
def x4(spark, sf):
    short = F.concat_ws("/", "source_id", "kind", (F.col("entry_id") % 39).cast("string")).alias("path")
    t = a.tree_docs(spark, sf)
    return changes.merge_draft(t.where("entry_id % 2 = 0").select(short), t.where("entry_id % 2 = 1 and kind <> 'fr'").select(short))


_REST = a.with_tables(
    a.TREE_DOCS,
    "s AS (SELECT entry_id, source_id || '/' || kind || '/' || (entry_id % 39) AS path, unreadable, kind FROM tree_docs)",
    "i AS (SELECT entry_id, path AS origin FROM s WHERE unreadable)",
    "p AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM s WHERE NOT unreadable AND kind <> 'fr')",
)


@query("x11_restore", _REST + " SELECT entry_id, origin, CASE WHEN regexp_replace(origin, '/[^/]*$', '') NOT IN (SELECT folder FROM p) THEN 'no_folder' WHEN origin IN (SELECT path FROM p) THEN 'taken' WHEN row_number() OVER (PARTITION BY origin ORDER BY entry_id) > 1 THEN 'taken_in_plan' ELSE 'planned' END AS state FROM i")
def x11(spark, sf):
    s = a.tree_docs(spark, sf).select("entry_id", F.concat_ws("/", "source_id", "kind", (F.col("entry_id") % 39).cast("string")).alias("path"), "unreadable", "kind")
    items = s.where("unreadable").select("entry_id", F.col("path").alias("origin"))
    return changes.restore_draft(items, s.where("not unreadable and kind <> 'fr'").select("path"))


_ZONES = ("America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC")
_RUNS = """runs AS (SELECT event_id, ts AS after, ['America/New_York', 'Europe/Berlin', 'Australia/Lord_Howe', 'UTC'][1 + event_id % 4] AS zone, user_id % 24 AS hour, (event_id * 7) % 60 AS minute, CASE WHEN user_id % 3 = 0 THEN 1 + user_id % 7 END AS weekday
  FROM (SELECT * REPLACE (ts + INTERVAL (40 * (event_id % 20)) DAY AS ts) FROM events)),
days AS (SELECT *, CAST(timezone(zone, timezone('UTC', after)) AS DATE) + CAST(n AS INTEGER) AS d FROM runs, range(0, 9) t(n)),
walls AS (SELECT *, d + to_hours(hour) + to_minutes(minute) AS wall, timezone('UTC', timezone(zone, d + to_hours(hour) + to_minutes(minute))) AS late FROM days WHERE weekday IS NULL OR isodow(d) = weekday),
-- of a wall time that occurs twice the first
times AS (SELECT *, CASE WHEN timezone(zone, timezone('UTC', late - INTERVAL 60 MINUTE)) = wall THEN late - INTERVAL 60 MINUTE WHEN timezone(zone, timezone('UTC', late - INTERVAL 30 MINUTE)) = wall THEN late - INTERVAL 30 MINUTE ELSE late END AS due FROM walls)"""


@query("t8_schedule", f"WITH {_RUNS} SELECT event_id, CAST(epoch(min(due)) AS BIGINT) AS next_s FROM times WHERE due > after GROUP BY 1")
def t8(spark, sf):
    """An event's next scan by a zone, a time of day and, for a third of the users, a weekday; over a year and both changes of the clock."""
    e = a.table(spark, sf, "events")
    zone = F.element_at(F.array(*(F.lit(z) for z in _ZONES)), (1 + F.col("event_id") % 4).cast("int"))
    moved = F.expr("cast(ts as timestamp_ntz) + make_dt_interval(cast(40 * (event_id % 20) as int))")
    runs = e.select(
        "event_id", moved.alias("after"), zone.alias("zone"), (F.col("user_id") % 24).cast("int").alias("hour"), ((F.col("event_id") * 7) % 60).cast("int").alias("minute"),
        F.when(F.col("user_id") % 3 == 0, 1 + F.col("user_id") % 7).alias("weekday"),
    )
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', next_at)")
    return changes.next_runs(runs).select("event_id", seconds.alias("next_s"))
