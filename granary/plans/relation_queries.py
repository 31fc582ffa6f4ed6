"""Relations between the folders of a nested tree with gaps, hard links and archives: R1-R7, R9, R10, J14, O9, O10, O15.

The SQL walks from each folder to all its holders and compares name prefixes; the
operators join keys and folder names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import relate
from granary.plans.registry import query
from granary.sources import nested


def _tree(key: str) -> str:
    """Folders, their sums and what they hold, with ``key`` naming a file's content."""
    return f"""WITH {nested.SQL},
inodes AS (SELECT *, source_id || '/' || path AS own, CASE WHEN archive IS NULL AND nlink > 1 AND stable THEN source_id || '/' || dev || '/' || ino END AS inode FROM line_files WHERE size > 0),
ent AS (SELECT regexp_replace(own, '/[^/]*$', '') AS node, {key} AS key, coalesce(inode, own) AS phys, size, source_id || '/' || archive AS arc, content_state FROM inodes),
arcs AS (SELECT source_id || '/' || path AS z, packed FROM line_archives),
shut AS (SELECT source_id || '/' || path AS node FROM folder_gaps),
lone AS (SELECT node FROM ent UNION SELECT z FROM arcs UNION SELECT node FROM shut),
up AS MATERIALIZED (SELECT DISTINCT array_to_string(string_split(node, '/')[: k], '/') AS n, array_to_string(string_split(node, '/')[: j], '/') AS u, j AS level
  FROM (SELECT node, unnest(range(1, len(string_split(node, '/')) + 1)) AS k FROM lone), range(1, 12) t(j) WHERE j <= k),
nodes AS MATERIALIZED (SELECT n AS node, max(level) AS depth FROM up GROUP BY 1),
placed AS MATERIALIZED (SELECT node, depth, z AS arc, CASE WHEN z IS NULL THEN replace(node, '/', chr(1))
  ELSE replace(regexp_replace(z, '/[^/]*$', ''), '/', chr(1)) || chr(2) || regexp_extract(z, '[^/]*$') || replace(substr(node, length(z) + 1), '/', chr(1)) END AS place
  FROM nodes LEFT JOIN arcs ON node = z OR starts_with(node, z || '/')),
is_gap AS (SELECT *, key IS NULL AND content_state <> 'sampled' AS gap FROM ent),
sums AS MATERIALIZED (SELECT u AS node, coalesce(sum(size), 0)::BIGINT AS bytes, count(size) AS files, (count(*) FILTER (gap) + count(*) FILTER (closed))::BIGINT AS gaps, count(*) FILTER (gap) AS gap_files,
  coalesce(sum(size) FILTER (gap), 0)::BIGINT AS gap_bytes, count(*) FILTER (NOT gap) AS keyed
  FROM (SELECT node, size, gap, false AS closed FROM is_gap UNION ALL SELECT node, NULL, NULL, true FROM shut UNION ALL SELECT z, NULL, NULL, NULL FROM arcs) JOIN up ON n = node GROUP BY 1),
many AS (SELECT key, max(size) AS size FROM ent WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
kept AS MATERIALIZED (SELECT * FROM ent WHERE key IN (SELECT key FROM many)),
under AS MATERIALIZED (SELECT u AS node, key, count(*) AS n, sum(k.size)::BIGINT AS bytes, min(phys) AS low, max(phys) AS high FROM kept k JOIN up ON n = node GROUP BY ALL)"""


_FINAL = _tree("CASE WHEN content_state = 'hashed' THEN 'c' || digest WHEN content_state = 'sampled' AND inode IS NOT NULL THEN 'i' || inode END")
_EARLY = _tree("CASE WHEN content_state IN ('hashed', 'pending') THEN 's' || size WHEN content_state = 'sampled' AND inode IS NOT NULL THEN 'i' || inode END")

#: ``partner``: a, b, bytes, entries.
_PARTNER = """,
top3 AS MATERIALIZED (SELECT node AS a, key, row_number() OVER (PARTITION BY node ORDER BY m.size DESC, key) AS turn FROM under JOIN many m USING (key) QUALIFY turn <= 3),
spot AS MATERIALIZED (SELECT DISTINCT node AS d, key FROM kept),
reach AS (SELECT a, key, turn, d, arg_min(u, level) AS b FROM top3 JOIN spot USING (key) JOIN up ON n = d
  WHERE d <> a AND NOT starts_with(d, a || '/') AND u <> a AND NOT starts_with(a, u || '/') GROUP BY ALL),
ranked AS (SELECT a, turn, b, place, row_number() OVER (PARTITION BY a, key ORDER BY place) AS k FROM (SELECT DISTINCT a, key, turn, b FROM reach) JOIN placed ON node = b QUALIFY k <= 64),
tops AS (SELECT a, b, min((turn, place)) AS turn FROM ranked GROUP BY ALL),
rated AS (SELECT a, b, turn, sum(x.bytes)::BIGINT AS bytes, sum(x.n)::BIGINT AS entries FROM tops JOIN under x ON x.node = a
  WHERE EXISTS (SELECT 1 FROM under y WHERE y.node = b AND y.key = x.key) GROUP BY ALL),
tied AS (SELECT *, count(*) OVER (PARTITION BY a) AS ties, row_number() OVER (PARTITION BY a ORDER BY turn) AS k FROM (SELECT * FROM rated QUALIFY rank() OVER (PARTITION BY a ORDER BY bytes DESC, entries DESC) = 1)),
best AS MATERIALIZED (SELECT a, b AS t, bytes, entries, greatest(1, 16 // ties) AS chains FROM tied WHERE k <= 16),
led AS (SELECT a, t, bytes, entries, chains, arg_min(key, turn) AS key FROM best JOIN top3 USING (a) WHERE EXISTS (SELECT 1 FROM under y WHERE y.node = t AND y.key = top3.key) GROUP BY ALL),
firsts AS MATERIALIZED (SELECT a, t, bytes, entries, d FROM led JOIN spot USING (key) JOIN placed ON node = d WHERE d = t OR starts_with(d, t || '/') QUALIFY row_number() OVER (PARTITION BY a, t ORDER BY place) <= chains),
steps AS (SELECT a, t, bytes, entries, d, u, level FROM firsts JOIN up ON n = d WHERE u = t OR starts_with(u, t || '/')),
stepped AS (SELECT a, u, sum(x.bytes)::BIGINT AS b_u, sum(x.n)::BIGINT AS e_u FROM (SELECT DISTINCT a, u FROM steps) JOIN under x ON x.node = a WHERE EXISTS (SELECT 1 FROM under y WHERE y.node = u AND y.key = x.key) GROUP BY ALL),
ends AS MATERIALIZED (SELECT DISTINCT a, bytes, entries, b FROM (SELECT a, t, d, bytes, entries, arg_max(u, level) AS b FROM steps JOIN stepped USING (a, u) WHERE b_u = bytes AND e_u = entries GROUP BY ALL)),
twins AS (SELECT a, b, count(*) OVER (PARTITION BY a) > 1 AND s.gaps = 0 AND ends.entries = s.keyed AND o.gaps = 0 AND o.keyed > 0
    AND o.keyed = (SELECT coalesce(sum(x.n), 0) FROM under x WHERE x.node = b AND EXISTS (SELECT 1 FROM under y WHERE y.node = a AND y.key = x.key)) AS twin, ends.bytes, ends.entries
  FROM ends JOIN sums s ON s.node = a JOIN sums o ON o.node = b),
partner AS MATERIALIZED (SELECT a, b, bytes, entries FROM twins QUALIFY row_number() OVER (PARTITION BY a ORDER BY twin, len(string_split(b, '/')) DESC, substr(b, length(string_split(b, '/')[1]) + 2), b) = 1)"""

#: ``named``: node, lifted, lowered.
_NAMES = """,
alike AS MATERIALIZED (SELECT x.node AS n, y.node AS u, x.depth AS dn, y.depth AS du FROM placed x JOIN up ON up.n = x.node JOIN placed y ON y.node = up.u JOIN sums a ON a.node = x.node JOIN sums b ON b.node = y.node
  WHERE (a.bytes, a.files, a.gap_files, a.gap_bytes, a.gaps, a.keyed) = (b.bytes, b.files, b.gap_files, b.gap_bytes, b.gaps, b.keyed)),
shells AS (SELECT u AS node, n AS z FROM alike JOIN arcs ON n = z WHERE u <> n),
forks AS (SELECT regexp_replace(node, '/[^/]*$', '') AS node, count(*) AS children FROM nodes WHERE contains(node, '/') GROUP BY 1),
stops AS (SELECT node FROM nodes LEFT JOIN forks USING (node) WHERE coalesce(children, 0) <> 1 OR node IN (SELECT z FROM arcs)),
high AS (SELECT n AS node, arg_min(u, du) AS up_to FROM alike JOIN placed p ON p.node = n WHERE p.arc IS NULL OR u = p.arc OR starts_with(u, p.arc || '/') GROUP BY 1),
low AS (SELECT u AS node, arg_max(n, dn) AS down_to FROM alike a WHERE NOT EXISTS (SELECT 1 FROM up JOIN stops ON stops.node = up.u WHERE up.n = a.n AND up.u <> a.n AND up.level >= a.du) GROUP BY 1),
named AS MATERIALIZED (SELECT node, coalesce(z, up_to) AS lifted, coalesce(z, down_to) AS lowered FROM high JOIN low USING (node) LEFT JOIN shells USING (node))"""

#: ``rel``: a, b, relation, with every side named.
_LABELS = (
    _PARTNER
    + _NAMES
    + """,
facing AS (SELECT p.*, s.bytes AS bytes_a, o.bytes AS bytes_b, s.gaps = 0 AND p.entries = s.keyed AS a_in,
    coalesce((SELECT sum(x.bytes) FROM under x WHERE x.node = p.b AND EXISTS (SELECT 1 FROM under y WHERE y.node = p.a AND y.key = x.key)), 0) AS back,
    o.gaps = 0 AND o.keyed > 0 AND o.keyed = (SELECT coalesce(sum(x.n), 0) FROM under x WHERE x.node = p.b AND EXISTS (SELECT 1 FROM under y WHERE y.node = p.a AND y.key = x.key)) AS b_in,
    na.lifted AS la, nb.lifted AS lb, na.lowered AS wa, nb.lowered AS wb, EXISTS (SELECT 1 FROM placed WHERE node = na.lowered AND arc IS NOT NULL) AS pa, EXISTS (SELECT 1 FROM placed WHERE node = nb.lowered AND arc IS NOT NULL) AS pb
  FROM partner p JOIN sums s ON s.node = p.a JOIN sums o ON o.node = p.b JOIN named na ON na.node = p.a JOIN named nb ON nb.node = p.b),
kinds AS (SELECT *, CASE WHEN a_in AND b_in THEN 'same' WHEN a_in THEN 'inside' WHEN bytes_a > 0 AND bytes * 100 >= 50 * bytes_a THEN 'overlap' END AS relation,
    substr(wa, length(string_split(wa, '/')[1]) + 2) AS ta, substr(wb, length(string_split(wb, '/')[1]) + 2) AS tb FROM facing),
sided AS (SELECT *, CASE WHEN relation = 'same' AND pa <> pb THEN pb WHEN relation = 'same' THEN ta < tb OR (ta = tb AND wa < wb)
    WHEN relation = 'overlap' THEN bytes_b > 0 AND back / bytes_b::DOUBLE > bytes / bytes_a::DOUBLE ELSE false END AS turned FROM kinds WHERE relation IS NOT NULL),
rel AS MATERIALIZED (SELECT DISTINCT CASE WHEN relation = 'same' THEN CASE WHEN turned THEN wb ELSE wa END WHEN turned THEN lb ELSE la END AS a,
    CASE WHEN relation = 'same' THEN CASE WHEN turned THEN wa ELSE wb END WHEN turned THEN la ELSE lb END AS b, relation FROM sided)"""
)

#: ``fig``: rel with what is matched, redundant and on one side only.
_FIGURES = (
    _LABELS
    + """,
ways AS (SELECT a, b FROM rel UNION SELECT b, a FROM rel),
shares AS MATERIALIZED (SELECT a, b, sum(x.bytes)::BIGINT AS bytes, sum(x.n)::BIGINT AS files FROM ways JOIN under x ON x.node = a WHERE EXISTS (SELECT 1 FROM under y WHERE y.node = b AND y.key = x.key) GROUP BY ALL),
hits AS (SELECT r.a, r.b, k.arc, k.size, k.key LIKE 'c%' AND (y.low <> k.phys OR y.high <> k.phys) AS free FROM (SELECT DISTINCT a, b FROM rel) r JOIN kept k ON k.node = r.a OR starts_with(k.node, r.a || '/') JOIN under y ON y.node = r.b AND y.key = k.key),
freed AS (SELECT a, b, sum(size)::BIGINT AS bytes FROM hits WHERE arc IS NULL AND free GROUP BY ALL UNION ALL
  SELECT a, b, packed FROM (SELECT a, b, arc, count(*) AS n, bool_and(free) AS free FROM hits WHERE arc IS NOT NULL AND NOT starts_with(a, arc || '/') GROUP BY ALL) h JOIN arcs ON arc = z JOIN sums s ON s.node = arc WHERE free AND gaps = 0 AND n = keyed),
redundant AS (SELECT a, b, sum(bytes)::BIGINT AS redundant FROM freed GROUP BY ALL),
fig AS (SELECT r.*, coalesce(m.bytes, 0) AS matched, coalesce(d.redundant, 0)::BIGINT AS redundant, s.bytes AS bytes_a, s.files AS files_a, o.bytes AS bytes_b, o.files AS files_b,
    s.files - coalesce(m.files, 0) - s.gap_files AS only_files_a, s.bytes - coalesce(m.bytes, 0) - s.gap_bytes AS only_bytes_a,
    o.files - coalesce(w.files, 0) - o.gap_files AS only_files_b, o.bytes - coalesce(w.bytes, 0) - o.gap_bytes AS only_bytes_b
  FROM rel r LEFT JOIN shares m ON m.a = r.a AND m.b = r.b LEFT JOIN shares w ON w.a = r.b AND w.b = r.a LEFT JOIN redundant d ON d.a = r.a AND d.b = r.b JOIN sums s ON s.node = r.a JOIN sums o ON o.node = r.b)"""
)


def snapshot(spark, sf, provisional=False):
    return relate.snapshot(nested.files(spark, sf), nested.folder_gaps(spark, sf), nested.archives(spark, sf), provisional)


def figured(spark, sf):
    s = snapshot(spark, sf)
    return relate.figures(relate.labels(s), s, nested.archives(spark, sf))


@query("r1_match", _FINAL + _FIGURES + " SELECT * FROM fig")
def r1(spark, sf):
    return figured(spark, sf)


@query("r2_inside", _FINAL + _PARTNER + " SELECT a, b, p.bytes, p.entries FROM partner p JOIN sums s ON s.node = a WHERE gaps = 0 AND keyed > 0 AND p.entries = keyed")
def r2(spark, sf):
    s = snapshot(spark, sf)
    return relate.inside(relate.partners(s), s.folders).select("a", "b", "bytes", "entries")


@query("r3_partner", _FINAL + _PARTNER + " SELECT * FROM partner")
def r3(spark, sf):
    return relate.partners(snapshot(spark, sf)).select("a", "b", "bytes", "entries")


@query("r4_labels", _FINAL + _LABELS + " SELECT * FROM rel")
def r4(spark, sf):
    return relate.labels(snapshot(spark, sf))


@query("r5_names", _FINAL + _NAMES + " SELECT * FROM named")
def r5(spark, sf):
    return relate.names(snapshot(spark, sf).folders)


@query("r6_maximal")
def r6(spark, sf):
    """Sequential by definition, so held against a plain loop in the tests instead of SQL."""
    s = snapshot(spark, sf)
    return relate.maximal(relate.labels(s, whole=True), s.folders)


@query(
    "r7_candidates",
    _EARLY
    + _PARTNER
    + _NAMES
    + """, near AS (SELECT DISTINCT x.lifted AS x, y.lifted AS y FROM partner p JOIN sums s ON s.node = p.a JOIN named x ON x.node = p.a JOIN named y ON y.node = p.b WHERE s.bytes > 0 AND p.bytes * 100 >= 50 * s.bytes AND x.lifted <> y.lifted),
    pairs AS MATERIALIZED (SELECT DISTINCT CASE WHEN p.place < q.place THEN x ELSE y END AS a, CASE WHEN p.place < q.place THEN y ELSE x END AS b FROM near JOIN placed p ON p.node = x JOIN placed q ON q.node = y),
    ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    spread AS (SELECT a, b, p.u AS x, q.u AS y FROM pairs JOIN up p ON p.n = a JOIN up q ON q.n = b WHERE NOT (p.u = a AND q.u = b))
    SELECT a, b FROM pairs WHERE (a, b) NOT IN (SELECT (s.a, s.b) FROM spread s JOIN ways w ON w.a = s.x AND w.b = s.y)""",
)
def r7(spark, sf):
    return relate.candidates(snapshot(spark, sf, provisional=True))


@query("o9_overlaps", _FINAL + _FIGURES + " SELECT a, b, matched, only_bytes_a, only_bytes_b FROM fig WHERE relation = 'overlap'")
def o9(spark, sf):
    found = figured(spark, sf).where("relation = 'overlap'").select("a", "b", "matched", "only_bytes_a", "only_bytes_b")
    return found.orderBy(F.desc("matched"), "a", "b")


@query(
    "o10_of_folder",
    _FINAL
    + _FIGURES
    + """, sides AS (SELECT a AS folder, b AS other, relation, matched, redundant, true AS is_a FROM fig UNION ALL SELECT b, a, relation, matched, redundant, false FROM fig)
    SELECT *, row_number() OVER (PARTITION BY folder ORDER BY redundant DESC, matched DESC, other, relation, is_a) AS place FROM sides QUALIFY place <= 10""",
)
def o10(spark, sf):
    """The ten foremost relations of each folder."""
    return relate.of_folders(figured(spark, sf), 10).withColumn("place", F.col("place").cast("long"))


@query("o15_ranking", _FINAL + _FIGURES + " SELECT a, b, relation, redundant, matched FROM fig")
def o15(spark, sf):
    return relate.ranking(figured(spark, sf)).select("a", "b", "relation", "redundant", "matched")
