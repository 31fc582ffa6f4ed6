"""Copies and places over files and archive members.

A9-A14, A20, A33, C7, C12, D1, D2, D5-D9, D18, F10, F11, F15, F16, J4, J12, O6,
PJ1, PJ2, R12, W1, X12, X13.  The SQL states each rule in its own words: places by
EXISTS over copies, not by the figures that the operators join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.paths import extension, with_ancestors
from granary.operators import places, purge
from granary.plans.registry import query
from granary.sources import inventory as inv
from granary.sources.adapters import closure_sql

PHYS = inv._PHYS


def tables(spark, sf):
    """(files, members with their archive's columns, copies)."""
    files = inv.files(spark, sf)
    members = places.placed_members(places.resolve_links(inv.raw_members(spark, sf)), inv.archives(spark, sf), files)
    return files, members, places.copies(files, members)


def placed(spark, sf):
    files, _, copy = tables(spark, sf)
    at = places.places(files, copy)
    return at.withColumn("disposable", places.disposable(F.col("category"), F.col("file_kind"), F.col("triage")))


_FAMILY = """CASE WHEN category IN ('personal_media','documents','source_project','application_user_data') THEN 'personal'
  WHEN category IN ('application_installation','application_configuration','os_installation','installer_download') THEN 'programs'
  WHEN category IN ('system_junk','cache','temporary_data','generated_artifacts') THEN 'disposable'
  WHEN category IN ('download_collection','backup','mixed') THEN 'containers'
  WHEN file_kind IN ('image','video','audio','document','source') THEN 'personal' WHEN file_kind IN ('installer','executable') THEN 'programs'
  WHEN file_kind = 'system' THEN 'disposable' ELSE 'containers' END"""
_PLACED = f"""keyed AS (SELECT f.*, {PHYS.format("f")} AS pkey, {_FAMILY} AS family FROM files f),
placed AS (SELECT *, family = 'disposable' AND triage <> 'review' AS disposable, CASE WHEN state <> 'present' OR quarantined THEN NULL WHEN size <= 0 THEN 'none'
  WHEN content_state IS NULL OR content_state IN ('pending', 'changed') THEN 'unchecked' WHEN content_state IN ('unique_size', 'sampled') THEN 'only_copy'
  WHEN content_state = 'unreadable' THEN 'unreadable'
  WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.digest AND c.source_id <> k.source_id) THEN 'other_source'
  WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.digest AND c.pkey <> k.pkey) THEN 'this_source' ELSE 'only_copy' END AS place FROM keyed k)"""


@query("r12_links", inv.sql() + " SELECT member_id, size, content_state, digest FROM members")
def r12(spark, sf):
    return places.resolve_links(inv.raw_members(spark, sf)).select("member_id", "size", "content_state", "digest")


@query("a12_copies", inv.sql() + " SELECT digest, count(DISTINCT pkey) AS n_copies FROM copy GROUP BY 1")
def a12(spark, sf):
    return places.contents(tables(spark, sf)[2]).select("digest", "n_copies")


@query(
    "a13_with_copies",
    inv.sql()
    + """ SELECT f.digest FROM files f WHERE f.content_state = 'hashed' AND f.state = 'present' AND NOT f.quarantined GROUP BY f.digest
    HAVING count(*) > 1 OR bool_or(f.digest IN (SELECT digest FROM copy WHERE member))""",
)
def a13(spark, sf):
    copy = tables(spark, sf)[2]
    per = copy.groupBy("digest").agg(F.count_if(~F.col("member")).alias("names"), F.bool_or("member").alias("inside"))
    return per.where("names > 1 or (names > 0 and inside)").select("digest")


@query("a14_physical_groups", inv.sql() + " SELECT digest, count(DISTINCT pkey) AS n_copies, max(size) * (count(DISTINCT pkey) - 1) AS surplus FROM copy GROUP BY 1 HAVING count(DISTINCT pkey) > 1")
def a14(spark, sf):
    copy = tables(spark, sf)[2]
    per = copy.groupBy("digest").agg(F.count_distinct("pkey").alias("n_copies"), F.max("size").alias("size")).where("n_copies > 1")
    return per.select("digest", "n_copies", (F.col("size") * (F.col("n_copies") - 1)).alias("surplus"))


@query("a33_single_source", inv.sql() + " SELECT digest, count(DISTINCT pkey) AS n_copies, min(source_id) <> max(source_id) AS many_sources FROM copy GROUP BY 1")
def a33(spark, sf):
    return places.contents(tables(spark, sf)[2]).select("digest", "n_copies", (F.col("n_sources") > 1).alias("many_sources"))


_COVERED = """counted AS (SELECT source_id, content_state, size FROM files WHERE state = 'present' AND NOT quarantined AND content_state IS NOT NULL
  UNION ALL SELECT f.source_id, m.content_state, m.size FROM members m JOIN archives a USING (archive_id) JOIN files f ON f.entry_id = m.archive_id
  WHERE a.listing = 'complete' AND f.state = 'present' AND NOT f.quarantined AND m.content_state IS NOT NULL)"""
_COVER = ", ".join(
    f"count(*) FILTER ({t}) AS {n}_files, CAST(coalesce(sum(size) FILTER ({t}), 0) AS BIGINT) AS {n}_bytes"
    for n, t in (("candidate", "content_state <> 'unique_size'"), ("checked", "content_state IN ('hashed','sampled')"), ("unchecked", "content_state IN ('pending','changed')"), ("unreadable", "content_state = 'unreadable'"))
)


def counted(spark, sf):
    files, members, _ = tables(spark, sf)
    live = (F.col("state") == "present") & ~F.col("quarantined") & F.col("content_state").isNotNull()
    return files.where(live).select("source_id", "content_state", "size").unionByName(
        members.where(live & (F.col("listing") == "complete")).select("source_id", "content_state", "size")
    )


@query("a9_coverage", inv.sql(_COVERED) + f" SELECT source_id, {_COVER} FROM counted GROUP BY 1")
def a9(spark, sf):
    return places.coverage(counted(spark, sf), "source_id")


@query("a10_coverage_total", inv.sql(_COVERED) + f" SELECT {_COVER} FROM counted")
def a10(spark, sf):
    return places.coverage(counted(spark, sf))


_BUCKET = "CASE WHEN {0} IN ('hashed','sampled') THEN 1 WHEN {0} IN ('pending','changed') THEN 2 WHEN {0} = 'unreadable' THEN 3 ELSE 0 END"


@query(
    "a11_deltas",
    inv.sql("moved AS (SELECT source_id, size, " + _BUCKET.format("content_state") + " AS b0, CASE WHEN entry_id % 6 = 0 THEN 1 WHEN entry_id % 6 = 1 THEN 3 ELSE " + _BUCKET.format("content_state") + " END AS b1 FROM files)")
    + """ SELECT source_id, CAST(sum(CASE WHEN b0 = b1 THEN 0 ELSE CAST(b1 > 0 AS INT) - CAST(b0 > 0 AS INT) END) AS BIGINT) AS candidate_files,
    CAST(sum(CASE WHEN b0 = b1 THEN 0 ELSE size * (CAST(b1 = 1 AS INT) - CAST(b0 = 1 AS INT)) END) AS BIGINT) AS checked_bytes,
    CAST(sum(CASE WHEN b0 = b1 THEN 0 ELSE CAST(b1 = 3 AS INT) - CAST(b0 = 3 AS INT) END) AS BIGINT) AS unreadable_files FROM moved GROUP BY 1""",
)
def a11(spark, sf):
    """Signed changes when some files are read (hashed) and some turn out unreadable."""
    f = inv.files(spark, sf)
    into = F.when(F.col("entry_id") % 6 == 0, "hashed").when(F.col("entry_id") % 6 == 1, "unreadable").otherwise(F.col("content_state"))
    rows = f.select("source_id", F.col("content_state"), F.col("size"), F.lit(-1).alias("sign")).unionByName(f.select("source_id", into.alias("content_state"), "size", F.lit(1).alias("sign")))
    is_ = lambda *s: F.coalesce(F.col("content_state").isin(*s), F.lit(False)).cast("int") * F.col("sign")
    known = is_("hashed", "sampled", "pending", "changed", "unreadable")
    return rows.groupBy("source_id").agg(
        F.sum(known).cast("long").alias("candidate_files"), F.sum(is_("hashed", "sampled") * F.col("size")).alias("checked_bytes"), F.sum(is_("unreadable")).cast("long").alias("unreadable_files")
    )


@query(
    "d1_states",
    inv.sql(
        f"""every AS (SELECT f.entry_id AS ref, false AS member, f.size, f.content_state AS st, f.sample, {PHYS.format("f")} AS pkey FROM files f WHERE state = 'present' AND NOT quarantined AND content_state IS NOT NULL
        UNION ALL SELECT m.member_id, true, m.size, m.content_state, NULL, 'm' || {PHYS.format("f")} || '/' || coalesce(m.link_path, m.path) FROM members m JOIN archives a USING (archive_id) JOIN files f ON f.entry_id = m.archive_id
          WHERE a.listing = 'complete' AND f.state = 'present' AND NOT f.quarantined AND m.content_state IS NOT NULL)""",
        "shared AS (SELECT size, min(pkey) <> max(pkey) AS shared FROM every GROUP BY 1)",
    )
    + """ SELECT ref AS entry_id, CASE WHEN st = 'hashed' THEN 'hashed' WHEN NOT shared THEN 'unique_size' WHEN st IN ('changed', 'unreadable') THEN st
      WHEN sample IS NOT NULL AND size >= 16777216 AND NOT EXISTS (SELECT 1 FROM every o WHERE o.size = e.size AND o.pkey <> e.pkey AND (o.member OR o.sample IS NULL OR o.sample = e.sample)) THEN 'sampled'
      ELSE 'pending' END AS next_state FROM every e JOIN shared USING (size) WHERE NOT member""",
)
def d1(spark, sf):
    files, members, _ = tables(spark, sf)
    return places.size_states(files, members).select("entry_id", "next_state")


@query(
    "d2_distinct_sample",
    inv.sql(f"large AS (SELECT entry_id, size * 100000000 AS size, sample, {PHYS.format('f')} AS pkey FROM files f WHERE state = 'present' AND NOT quarantined AND content_state IS NOT NULL AND content_state <> 'hashed')")
    + """ SELECT entry_id, sample IS NOT NULL AND size >= 16777216 AND NOT EXISTS (SELECT 1 FROM large o WHERE o.size = e.size AND o.pkey <> e.pkey AND (o.sample IS NULL OR o.sample = e.sample))
      AND EXISTS (SELECT 1 FROM large o WHERE o.size = e.size AND o.pkey <> e.pkey) AND (SELECT any_value(content_state) FROM files x WHERE x.entry_id = e.entry_id) NOT IN ('changed', 'unreadable') AS sampled FROM large e""",
)
def d2(spark, sf):
    """The sample test on files made large enough to be sampled."""
    files, members, _ = tables(spark, sf)
    large = files.where("content_state <> 'hashed'").withColumn("size", F.col("size") * 100_000_000)
    return places.size_states(large, members.where("1 = 0")).select("entry_id", (F.col("next_state") == "sampled").alias("sampled"))


@query("d5_place", inv.sql(_PLACED) + " SELECT entry_id, place FROM placed")
def d5(spark, sf):
    return placed(spark, sf).select("entry_id", "place")


_MPLACE = f"""inner_ AS (SELECT m.*, f.source_id, f.online, f.state, f.quarantined, a.listing, 'm' || {PHYS.format("f")} || '/' || coalesce(m.link_path, m.path) AS pkey
  FROM members m JOIN archives a USING (archive_id) JOIN files f ON f.entry_id = m.archive_id),
mplaced AS (SELECT *, CASE WHEN state <> 'present' OR quarantined THEN NULL WHEN size <= 0 THEN 'none' WHEN content_state IS NULL OR content_state IN ('pending','changed') THEN 'unchecked'
  WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = i.digest AND c.source_id <> i.source_id) THEN 'other_source'
  WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = i.digest AND c.pkey <> i.pkey) THEN 'this_source' ELSE 'only_copy' END AS place FROM inner_ i WHERE listing = 'complete')"""


def placed_members(spark, sf):
    _, members, copy = tables(spark, sf)
    return places.places(members.where("listing = 'complete'"), copy).withColumn("disposable", F.lit(False))


@query("d6_member_place", inv.sql(_MPLACE) + " SELECT member_id, place FROM mplaced")
def d6(spark, sf):
    return placed_members(spark, sf).select("member_id", "place")


@query(
    "d7_offline_only",
    inv.sql()
    + """ SELECT entry_id FROM files f WHERE state = 'present' AND NOT quarantined AND content_state = 'hashed'
    AND EXISTS (SELECT 1 FROM copy c WHERE c.digest = f.digest AND c.source_id <> f.source_id) AND NOT EXISTS (SELECT 1 FROM copy c WHERE c.digest = f.digest AND c.source_id <> f.source_id AND c.online)""",
)
def d7(spark, sf):
    return placed(spark, sf).where("offline_only").select("entry_id")


_SUMS = (
    "sums AS (SELECT source_id, ancestor, "
    + ", ".join(
        f"CAST(coalesce(sum(n) FILTER ({t}), 0) AS BIGINT) AS {p}_files, CAST(coalesce(sum(size) FILTER ({t}), 0) AS BIGINT) AS {p}_bytes"
        for p, t in [(p, f"place = '{p}' AND NOT disposable") for p in ("only_copy", "this_source", "unchecked", "unreadable", "other_source")] + [("disposable", "disposable")]
    )
    + " FROM closure WHERE place IN ('only_copy','this_source','unchecked','unreadable','other_source') GROUP BY ALL)"
)


#: ``dealt``: placed files, with complete archives dealt over the places of their members.
_DEALT = f"""{_MPLACE},
eff AS (SELECT i.archive_id, i.size, CASE WHEN p.place = 'other_source' THEN 'other_source' WHEN p.place = 'this_source' AND i.place = 'only_copy' THEN 'this_source' ELSE i.place END AS place
  FROM mplaced i JOIN placed p ON p.entry_id = i.archive_id WHERE i.place IN ('only_copy','this_source','unchecked','unreadable','other_source')),
aw AS (SELECT p.entry_id, p.size, [coalesce(sum(e.size) FILTER (e.place = x), 0) FOR x IN []]::HUGEINT[] AS none, [{", ".join(f"coalesce(sum(e.size) FILTER (e.place = '{x}'), 0)" for x in places.ORDER)}]::HUGEINT[] AS w
  FROM placed p JOIN eff e ON e.archive_id = p.entry_id WHERE NOT p.disposable AND p.place IN ('only_copy','this_source','unchecked','unreadable','other_source') GROUP BY p.entry_id, p.size),
{places.split_sql("aw")},
dealt AS (SELECT entry_id, source_id, path, state, disposable, place, size, 1 AS n FROM placed WHERE entry_id NOT IN (SELECT entry_id FROM aw)
  UNION ALL SELECT p.entry_id, source_id, path, state, disposable, [{", ".join(f"'{x}'" for x in places.ORDER)}][k], shares[k], CASE WHEN len([j FOR j IN range(1, k) IF w[j] > 0]) = 0 THEN 1 ELSE 0 END
  FROM split s JOIN placed p USING (entry_id), range(1, 6) t(k) WHERE w[k] > 0)""".replace("[coalesce(sum(e.size) FILTER (e.place = x), 0) FOR x IN []]::HUGEINT[] AS none, ", "")


def dealt(spark, sf, rows):
    """``placed`` rows for sums, with complete archives dealt over places."""
    own = rows.select(F.col("entry_id").alias("archive_id"), F.col("place").alias("own_place"))
    return places.with_archives_split(rows, places.cover(places.sums(placed_members(spark, sf), "archive_id"), own))


@query("a20_place_sums", inv.sql(_PLACED, _DEALT, closure_sql("dealt", True), _SUMS) + " SELECT * FROM sums")
def a20(spark, sf):
    return places.sums(with_ancestors(dealt(spark, sf, placed(spark, sf)), True), "source_id", "ancestor")


_BLIND = inv.PARTIAL_SQL + """, seen AS (SELECT source_id, ancestor, bool_or(state = 'unreadable') AS shut FROM closure GROUP BY ALL),
blind AS (SELECT source_id, ancestor, shut OR EXISTS (SELECT 1 FROM partial_folders p WHERE p.source_id = s.source_id AND (ancestor = '' OR p.path = ancestor OR starts_with(p.path, ancestor || '/'))) AS blind FROM seen s)"""


def blind(spark, sf, rows):
    return places.blind(rows, inv.partial_folders(spark, sf))


@query("f21_unreadable_below", inv.sql(_PLACED, closure_sql("placed", True), _BLIND) + " SELECT source_id, ancestor FROM blind WHERE blind")
def f21(spark, sf):
    return blind(spark, sf, inv.files(spark, sf)).where("blind").select("source_id", "ancestor")


@query("f22_complete", inv.sql(_PLACED, closure_sql("placed", True), _BLIND) + " SELECT source_id, ancestor, NOT blind AS complete FROM blind")
def f22(spark, sf):
    return blind(spark, sf, inv.files(spark, sf)).select("source_id", "ancestor", (~F.col("blind")).alias("complete"))


@query(
    "d8_folder_place",
    inv.sql(_PLACED, _DEALT, closure_sql("dealt", True), _SUMS, _BLIND)
    + """, decided AS (SELECT source_id, ancestor, blind, CASE WHEN only_copy_files > 0 THEN 'only_copy' WHEN this_source_files > 0 THEN 'this_source' WHEN unchecked_files > 0 THEN 'unchecked'
      WHEN unreadable_files > 0 THEN 'unreadable' WHEN other_source_files > 0 THEN 'other_source' ELSE 'none' END AS p FROM blind LEFT JOIN sums USING (source_id, ancestor))
    SELECT source_id, ancestor, CASE WHEN blind AND p IN ('other_source', 'none') THEN 'unreadable' ELSE p END AS place FROM decided""",
)
def d8(spark, sf):
    rows = placed(spark, sf)
    whole = blind(spark, sf, rows).join(places.sums(with_ancestors(dealt(spark, sf, rows), True), "source_id", "ancestor"), ["source_id", "ancestor"], "left")
    return whole.select("source_id", "ancestor", places.folder_place(~F.col("blind")).alias("place"))


@query("d18_children_places", inv.sql(_PLACED) + " SELECT source_id, string_split(path, '/')[1] AS child, place, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM placed WHERE place IS NOT NULL GROUP BY ALL")
def d18(spark, sf):
    rows = placed(spark, sf).where("place is not null")
    return rows.groupBy("source_id", F.substring_index("path", "/", 1).alias("child"), "place").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(
    "d9_archive_cover",
    inv.sql(_PLACED, _MPLACE)
    + """, eff AS (SELECT i.archive_id, i.size, CASE WHEN p.place = 'other_source' THEN 'other_source' WHEN p.place = 'this_source' AND i.place = 'only_copy' THEN 'this_source' ELSE i.place END AS place
      FROM mplaced i JOIN placed p ON p.entry_id = i.archive_id WHERE i.place IN ('only_copy','this_source','unchecked','unreadable','other_source'))
    SELECT archive_id, """
    + ", ".join(f"count(*) FILTER (place = '{p}') AS {p}_files, CAST(coalesce(sum(size) FILTER (place = '{p}'), 0) AS BIGINT) AS {p}_bytes" for p in ("only_copy", "this_source", "unchecked", "unreadable", "other_source"))
    + " FROM eff GROUP BY 1",
)
def d9(spark, sf):
    own = placed(spark, sf).select(F.col("entry_id").alias("archive_id"), F.col("place").alias("own_place"))
    return places.cover(places.sums(placed_members(spark, sf), "archive_id"), own).drop("disposable_files", "disposable_bytes")


@query(
    "f10_duplicates",
    inv.sql(_PLACED)
    + """, q AS (SELECT entry_id, content_state, EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.digest AND c.pkey <> k.pkey) AS other FROM keyed k WHERE state = 'present' AND NOT quarantined)
    SELECT entry_id, content_state = 'hashed' AND other AS copies, content_state IN ('unique_size', 'sampled') OR (content_state = 'hashed' AND NOT other) AS uniq,
      content_state IN ('pending', 'changed', 'unreadable') AS unchecked FROM q WHERE content_state IS NOT NULL""",
)
def f10(spark, sf):
    at = placed(spark, sf).where("state = 'present' and not quarantined and content_state is not null").withColumn("d", places.duplicate_class())
    has = lambda x: F.array_contains("d", x)
    return at.select("entry_id", has("copies").alias("copies"), has("unique").alias("uniq"), has("unchecked").alias("unchecked"))


@query(
    "f11_elsewhere",
    inv.sql(_PLACED)
    + """ SELECT k.entry_id FROM keyed k WHERE k.state = 'present' AND NOT k.quarantined AND k.content_state = 'hashed' AND EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.digest AND c.pkey <> k.pkey
      AND (c.source_id <> k.source_id OR string_split(c.at_path, '/')[1] <> string_split(k.path, '/')[1]))""",
)
def f11(spark, sf):
    """Each file within its own top folder: is there a copy on another source or in another top folder?"""
    files, _, copy = tables(spark, sf)
    top = F.substring_index("at_path", "/", 1).alias("top")
    spots = copy.select("digest", "source_id", top, "pkey")
    of_spot = spots.groupBy("digest", "source_id", "top").agg(F.count_distinct("pkey").alias("here"))
    # Names of one inode may lie in several folders; another copy is another physical copy.
    of_key = spots.groupBy("digest", "pkey").agg(F.collect_set(F.struct("source_id", "top")).alias("spots")).where("size(spots) > 1")
    split = of_key.select("digest", "pkey", F.explode("spots").alias("s")).select("digest", F.col("s.source_id").alias("source_id"), F.col("s.top").alias("top"), "pkey")
    f = files.where("state = 'present' and not quarantined and content_state = 'hashed'").withColumns({"top": F.substring_index("path", "/", 1), "pkey": places.physical_key()})
    total = places.contents(copy).select("digest", "n_copies")
    at = f.join(total, "digest").join(of_spot, ["digest", "source_id", "top"])
    # Copies that have a name here and one outside count as outside too, but for the file's own.
    both = split.groupBy("digest", "source_id", "top").agg(F.count_distinct("pkey").alias("both"))
    own = split.select("digest", "source_id", "top", "pkey", F.lit(1).alias("own_both"))
    at = at.join(both, ["digest", "source_id", "top"], "left").join(own, ["digest", "source_id", "top", "pkey"], "left")
    outside = F.col("n_copies") - F.col("here") + F.coalesce("both", F.lit(0)) - F.coalesce("own_both", F.lit(0))
    return at.where(outside > 0).select("entry_id")


@query("f15_hide", inv.sql(_PLACED) + " SELECT entry_id FROM placed WHERE NOT disposable AND place IN ('only_copy', 'this_source', 'unchecked', 'unreadable')")
def f15(spark, sf):
    return placed(spark, sf).where("not disposable and place in ('only_copy', 'this_source', 'unchecked', 'unreadable')").select("entry_id")


@query("f16_disposable", inv.sql(_PLACED) + " SELECT entry_id, disposable FROM placed")
def f16(spark, sf):
    return inv.files(spark, sf).select("entry_id", places.disposable(F.col("category"), F.col("file_kind"), F.col("triage")).alias("disposable"))


@query("c7_family", inv.sql(_PLACED) + " SELECT entry_id, family FROM placed")
def c7(spark, sf):
    return inv.files(spark, sf).select("entry_id", places.file_family(F.col("category"), F.col("file_kind")).alias("family"))


@query("j4_semi", inv.sql(_PLACED) + " SELECT entry_id FROM keyed k WHERE EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.digest AND c.pkey <> k.pkey) AND state = 'present' AND NOT quarantined")
def j4(spark, sf):
    return placed(spark, sf).where("state = 'present' and not quarantined and n_copies > 1").select("entry_id")


@query(
    "j12_copies_of",
    inv.sql(_PLACED)
    + """ SELECT k.entry_id, c.member AS copy_member, c.id AS copy_id, c.source_id AS copy_source, c.pkey = k.pkey AS hard_link FROM keyed k JOIN copy c ON c.digest = k.digest
    WHERE k.entry_id % 100 = 0 AND k.content_state = 'hashed' AND NOT (c.id = k.entry_id AND NOT c.member)""",
)
def j12(spark, sf):
    """The other names of each content asked for: every hundredth file against all copies."""
    files, _, copy = tables(spark, sf)
    asked = files.where("entry_id % 100 = 0 and content_state = 'hashed'").select("entry_id", "digest", places.physical_key().alias("own"))
    return asked.join(copy, "digest").where("not (id = entry_id and not member)").select(
        "entry_id", F.col("member").alias("copy_member"), F.col("id").alias("copy_id"), F.col("source_id").alias("copy_source"), (F.col("pkey") == F.col("own")).alias("hard_link")
    )


@query("o6_only_here", inv.sql(_PLACED) + """ SELECT entry_id, row_number() OVER (PARTITION BY source_id, string_split(path, '/')[1] ORDER BY CASE WHEN NOT disposable AND place IN ('only_copy','this_source') THEN size ELSE 0 END DESC,
  CASE WHEN NOT disposable AND place IN ('unchecked','unreadable') THEN size ELSE 0 END DESC, entry_id DESC) AS nr FROM placed QUALIFY nr <= 50""")
def o6(spark, sf):
    """The first fifty files of each top folder by bytes that are only here."""
    from pyspark.sql import Window

    rows = placed(spark, sf).withColumn("key", places.only_here(F.col("place"), F.col("size"), F.col("disposable")))
    order = Window.partitionBy("source_id", F.substring_index("path", "/", 1)).orderBy(F.desc("key.here"), F.desc("key.open"), F.desc("entry_id"))
    return rows.withColumn("nr", F.row_number().over(order).cast("long")).where("nr <= 50").select("entry_id", "nr")


_PJ2 = "CASE WHEN state <> 'present' OR quarantined THEN NULL WHEN content_state = 'hashed' THEN (SELECT count(DISTINCT pkey) FROM copy c WHERE c.digest = k.digest) WHEN content_state IN ('unique_size', 'sampled') THEN 1 END"


@query("pj2_copies", inv.sql(_PLACED) + f" SELECT entry_id, {_PJ2} AS copies FROM keyed k")
def pj2(spark, sf):
    return placed(spark, sf).select("entry_id", places.shown_copies().cast("long").alias("copies"))


@query(
    "pj1_rows",
    inv.sql(_PLACED)
    + f""", labelled AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
    SELECT k.entry_id, source_id, path, size, file_kind, category, family, k.state, content_state, {_PJ2} AS copies, a.listing, CASE WHEN l.quality = 1 THEN 'keep' WHEN l.quality = 0 THEN 'discard' END AS decision
    FROM keyed k LEFT JOIN archives a ON a.archive_id = k.entry_id LEFT JOIN labelled l ON l.doc_id = k.entry_id""",
)
def pj1(spark, sf):
    """Rows as search shows them: the entry with its family, content, copies, listing and decision."""
    from granary.sources.adapters import table

    decided = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("entry_id")).agg(F.max("quality").alias("quality"))
    decision = F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "discard")
    rows = placed(spark, sf).join(inv.archives(spark, sf).withColumnRenamed("archive_id", "entry_id"), "entry_id", "left").join(decided, "entry_id", "left")
    return rows.select(
        "entry_id", "source_id", "path", "size", "file_kind", "category", places.file_family(F.col("category"), F.col("file_kind")).alias("family"),
        "state", "content_state", places.shown_copies().cast("long").alias("copies"), "listing", decision.alias("decision"),
    )


_WANT = f"""want AS (SELECT false AS wmember, entry_id AS wid, digest, source_id, pkey, place FROM placed WHERE place IN ('other_source', 'this_source')
  UNION ALL SELECT true, member_id, digest, source_id, pkey, place FROM mplaced WHERE place IN ('other_source', 'this_source'))"""


@query(
    "w1_preferred",
    inv.sql(_PLACED, _MPLACE, _WANT)
    + """ SELECT wmember AS member, wid AS id, want.place, c.member AS copy_member, c.id AS copy_id, c.source_id AS copy_source, NOT c.online AS copy_offline FROM want JOIN copy c ON c.digest = want.digest
    WHERE c.pkey <> want.pkey AND (c.source_id <> want.source_id) = (want.place = 'other_source')
    QUALIFY row_number() OVER (PARTITION BY wmember, wid ORDER BY CASE WHEN want.place = 'other_source' THEN NOT c.online ELSE false END, c.member, c.id) = 1""",
)
def w1(spark, sf):
    files, members, copy = tables(spark, sf)
    known = F.col("place").isin("other_source", "this_source")
    columns = ["member", "id", "digest", "source_id", "online", "pkey", "place"]
    f = placed(spark, sf).where(known).withColumns({"member": F.lit(False), "id": F.col("entry_id"), "pkey": places.physical_key()}).select(*columns)
    m = placed_members(spark, sf).where(known).withColumns({"member": F.lit(True), "id": F.col("member_id")}).select(*columns)
    return places.preferred(f.unionByName(m), copy)


@query(
    "c12_purge_class",
    inv.sql(_PLACED)
    + """ SELECT entry_id, CASE WHEN family = 'personal' OR regexp_extract(path, '[^/]\\.([^./]+)$', 1) = 'eml' OR entry_id % 23 = 7 THEN 'possibly_valuable' WHEN family = 'disposable' OR category = 'application_installation' THEN 'likely_junk' ELSE 'uncertain' END AS class FROM placed""",
)
def c12(spark, sf):
    f = inv.files(spark, sf)
    traits = F.when(F.col("entry_id") % 23 == 7, F.array(F.lit("contains_vcs"), F.lit("contains_database"))).otherwise(F.array(F.lit("contains_vcs")))
    return f.select("entry_id", places.purge_class(F.col("category"), F.col("file_kind"), traits, extension(F.substring_index("path", "/", -1))).alias("class"))


#: The items of a planned deletion: the files of every fifth remainder; one source's disk cannot be read.
_ITEM = "entry_id % 5 = 3"


_VERDICT = f"""verdicts AS (SELECT * FROM (SELECT k.*, CASE WHEN k.source_id LIKE '%9' OR k.state = 'unreadable' THEN 'unreadable' WHEN k.size = 0 OR a.listing = 'complete' THEN 'no_content'
      WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.text_digest AND c.pkey <> k.pkey AND c.online AND NOT (c.holder % 5 = 3)) THEN CASE WHEN file_kind = 'archive' THEN 'opaque_archive' ELSE 'safe' END
      WHEN EXISTS (SELECT 1 FROM copy c WHERE c.digest = k.text_digest AND c.pkey <> k.pkey AND NOT c.online AND NOT (c.holder % 5 = 3)) THEN 'copy_offline'
      WHEN file_kind = 'archive' THEN 'opaque_archive' ELSE 'unique' END AS verdict
    FROM (SELECT k.*, sha256(d.text) AS text_digest FROM keyed k JOIN documents d ON d.doc_id = k.entry_id) k LEFT JOIN archives a ON a.archive_id = k.entry_id WHERE k.{_ITEM} AND k.state <> 'missing'))"""


def checked(spark, sf):
    """Every file of the plan read in full and looked for among the copies that the plan leaves."""
    from granary.sources.adapters import table

    files, _, copy = tables(spark, sf)
    read = table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.sha2("text", 256).alias("read_digest"))
    listed = inv.archives(spark, sf).withColumnRenamed("archive_id", "entry_id")
    items = files.where(_ITEM).join(read, "entry_id").join(listed, "entry_id", "left").withColumns({"own": places.physical_key(), "item_readable": ~F.col("source_id").endswith("9")})
    return purge.judged(items, copy.where("not (holder % 5 = 3)"), "read_digest", F.col("listing"))


@query("x12_verdict", inv.sql(_PLACED, _VERDICT) + " SELECT entry_id, verdict FROM verdicts")
def x12(spark, sf):
    return checked(spark, sf).select("entry_id", "verdict")


_CLASS = """CASE WHEN family = 'personal' OR regexp_extract(path, '[^/]\\.([^./]+)$', 1) = 'eml' OR entry_id % 23 = 7 THEN 'possibly_valuable' WHEN family = 'disposable' OR category = 'application_installation' THEN 'likely_junk' ELSE 'uncertain' END"""
_GATES = f"""classed AS (SELECT *, CASE WHEN verdict = 'unique' THEN {_CLASS} END AS class, source_id NOT LIKE '%9' AS item_readable, CASE WHEN entry_id % 7 = 2 THEN 1700000000 END AS confirmed_at,
  CASE WHEN source_id LIKE '%4' THEN 1700000001 END AS junk_confirmed_at, CASE WHEN entry_id % 2 = 0 THEN 'a/copy' END AS copy_path FROM verdicts),
gates AS (SELECT *, (verdict IN ('unique', 'copy_offline', 'unreadable') OR (verdict = 'opaque_archive' AND copy_path IS NULL)) AND item_readable IS DISTINCT FROM false AS gated,
  confirmed_at IS NOT NULL OR (verdict = 'unique' AND class IS NOT DISTINCT FROM 'likely_junk' AND junk_confirmed_at IS NOT NULL) AS confirmed,
  verdict IN ('copy_offline', 'unreadable') OR (verdict = 'opaque_archive' AND copy_path IS NULL) OR (verdict = 'unique' AND class IS DISTINCT FROM 'likely_junk') AS one_by_one FROM classed)"""


def gates(spark, sf):
    """The check's rows with their class, and what was confirmed: some files by themselves, the junk of some sources as a group."""
    rows = checked(spark, sf)
    traits = F.when(F.col("entry_id") % 23 == 7, F.array(F.lit("contains_database"))).otherwise(F.array(F.lit("contains_vcs")))
    cls = places.purge_class(F.col("category"), F.col("file_kind"), traits, extension(F.substring_index("path", "/", -1)))
    rows = rows.withColumns(
        {
            "class": F.when(F.col("verdict") == "unique", cls), "is_file": F.lit(True), "copy_path": F.when(F.col("entry_id") % 2 == 0, "a/copy"),
            "confirmed_at": F.when(F.col("entry_id") % 7 == 2, 1_700_000_000), "junk_confirmed_at": F.when(F.col("source_id").endswith("4"), 1_700_000_001),
        }
    )
    verdict, junk = F.col("verdict"), F.col("class")
    return rows.withColumns(
        {
            "gated": purge.gated(verdict, F.col("copy_path"), F.col("item_readable")), "confirmed": purge.confirmed(F.col("confirmed_at"), verdict, junk, F.col("junk_confirmed_at")),
            "one_by_one": purge.confirmed_one_by_one(verdict, junk, F.col("copy_path")),
        }
    )


@query("f20_gates", inv.sql(_PLACED, _VERDICT, _GATES) + " SELECT entry_id, gated, confirmed, one_by_one FROM gates")
def f20(spark, sf):
    return gates(spark, sf).select("entry_id", "gated", "confirmed", "one_by_one")


@query(
    "a23_check_counts",
    inv.sql(_PLACED, _VERDICT, _GATES)
    + " SELECT verdict, coalesce(class, '') AS class, gated, confirmed, count(*) AS files, CAST(sum(CASE WHEN verdict = 'no_content' THEN 0 ELSE size END) AS BIGINT) AS bytes FROM gates GROUP BY ALL",
)
def a23(spark, sf):
    return purge.counts(gates(spark, sf))


@query("x15_unconfirmed", inv.sql(_PLACED, _VERDICT, _GATES) + " SELECT entry_id, verdict, class FROM gates WHERE gated AND NOT confirmed")
def x15(spark, sf):
    return purge.unconfirmed(gates(spark, sf)).select("entry_id", "verdict", "class")


@query(
    "x13_copy_search",
    inv.sql(_PLACED)
    + """, cand AS (SELECT k.entry_id AS want, CASE WHEN c.member THEN 2 ELSE 1 END AS arm, c.id FROM keyed k JOIN copy c ON c.digest = k.digest AND c.pkey <> k.pkey WHERE k.entry_id % 100 = 0
      UNION ALL SELECT k.entry_id, 3, o.entry_id FROM keyed k JOIN keyed o ON o.size = k.size AND o.pkey <> k.pkey WHERE k.entry_id % 100 = 0 AND k.size > 0 AND o.state = 'present' AND NOT o.quarantined AND o.content_state IN ('pending', 'changed'))
    SELECT want, arm, id, row_number() OVER (PARTITION BY want ORDER BY arm, id) AS nr FROM cand""",
)
def x13(spark, sf):
    """Where a copy would be looked for, in order: files of the digest, members of it, files of the size whose content is not known."""
    from pyspark.sql import Window

    files, _, copy = tables(spark, sf)
    keyed = files.withColumn("own", places.physical_key())
    asked = keyed.where("entry_id % 100 = 0").select(F.col("entry_id").alias("want"), "digest", "size", "own")
    same = asked.join(copy.select("digest", "pkey", "member", "id"), "digest").where("pkey <> own").select("want", F.when(F.col("member"), 2).otherwise(1).alias("arm"), "id")
    open_ = keyed.where("state = 'present' and not quarantined and content_state in ('pending', 'changed')").select("size", F.col("own").alias("pkey"), F.col("entry_id").alias("id"))
    by_size = asked.where("size > 0").join(open_, "size").where("pkey <> own").select("want", F.lit(3).alias("arm"), "id")
    return same.unionByName(by_size).withColumn("nr", F.row_number().over(Window.partitionBy("want").orderBy("arm", "id")).cast("long"))
