"""Dates of photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.runs import checkpoint, spread
from granary.operators import dates
from granary.plans.registry import query
from granary.sources import adapters as a

_P = a.with_tables(a.PHOTOS_EVENTS)
#: The present, for plausibility: fixed, so that results do not move.
NOW_NS, THIS_YEAR = 1_706_400_000_000_000_000, 2024

#: Names of nine forms, by the id's remainder; ``{}`` is how either engine writes a time.
_FORMS = ("IMG_{yyyyMMdd}_{HHmmss}.jpg", "PXL_{yyyyMMdd}_{HHmmss}123.jpg", "VID-{yyyyMMdd}-WA0007.mp4", "Screenshot_{yyyy}-{MM}-{dd}-{HH}-{mm}-{ss}.png", "Screenshot_{yyyyMMdd}-{HHmmss}.png",
          "Screenshot_{yyyy}-{MM}-{dd}_x.png", "{yyyyMMdd}_{HHmmss}~2.jpg", "{yyyy}-{MM}-{dd} {HH}.{mm}.{ss}.jpg", "img_{yyyyMMdd}_{HHmmss}7.jpg", "holiday {yyyy}.jpg", "IMG_{yyyy}1399_{HHmmss}.jpg")
_DUCK = {"yyyyMMdd": "%Y%m%d", "HHmmss": "%H%M%S", "yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def _written(ts, forms, pick):
    """The time in one of the forms; a single formatting call, as one call for each form makes code too long to be compiled."""
    java = ["".join((x if n % 2 else f"'{x}'") for n, x in enumerate(form.replace("{", "}").split("}")) if x) for form in forms]
    return F.call_function("date_format", ts, F.element_at(F.array(*map(F.lit, java)), (pick % len(forms)).cast("int") + 1))


def _formed(ts):
    """A file name for each event, of the form that its id picks."""
    return _written(ts, _FORMS, F.col("event_id"))


def _sql_form(form: str) -> str:
    for java, c in _DUCK.items():
        form = form.replace("{" + java + "}", c)
    return form


_NAMED = "named AS (SELECT event_id AS photo_id, ts, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN strftime(ts, '{_sql_form(f)}')" for k, f in enumerate(_FORMS)) + " END AS name FROM events)"
_STAMP = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"
_M1 = f"""m1 AS (SELECT photo_id, name, CASE photo_id % 11 WHEN 1 THEN {_STAMP} * 1000000000 + 123000000 WHEN 2 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) * 1000000000 WHEN 5 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) * 1000000000
  WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE {_STAMP} * 1000000000 END AS ns, CASE WHEN photo_id % 11 IN (8, 9, 10) THEN NULL WHEN photo_id % 11 IN (2, 5) THEN 'day' ELSE 'second' END AS precision FROM named)"""


def named(spark, sf):
    e = a.table(spark, sf, "events")
    return e.withColumn("name", _formed(F.col("ts"))).withColumnRenamed("event_id", "photo_id")


@query("m1_name_date", "WITH " + _NAMED + "," + _M1 + " SELECT photo_id, ns, precision FROM m1")
def m1(spark, sf):
    e = a.table(spark, sf, "events").withColumn("name", _formed(F.col("ts")))
    d = dates.name_date(F.col("name"))
    return e.withColumn("d", d).select(F.col("event_id").alias("photo_id"), "d.ns", "d.precision")


#: Folder paths by the id's remainder, with the date that each names.
_FOLDERS = (
    ("{yyyy}", "year"), ("{yyyy}-{MM} Trip", "month"), ("{yyyy}-{MM}-{dd}_x", "day"), ("{yyyy}/{MM}", "month"), ("{yyyy}/{MM} Bahia/{dd}", "day"), ("{yyyy}/{MM}-{dd}-{yyyy}", None),
    ("{dd}-{MM}-{yyyy}", None), ("misc", None), ("1985", None), ("{yyyy}/13", None), ("{yyyy}/{MM}-28", "month"), ("{yyyy}x", None),
)


def _foldered(ts):
    return _written(ts, [form for form, _ in _FOLDERS], F.col("event_id"))


_FOLDER = "foldered AS (SELECT event_id AS photo_id, ts, CASE event_id % 12 " + " ".join(f"WHEN {k} THEN strftime(ts, '{_sql_form(f)}')" for k, (f, _) in enumerate(_FOLDERS)) + " END AS folder FROM events)"
_PREC = "CASE photo_id % 12 WHEN 5 THEN CASE WHEN day(ts) > 12 THEN 'month' END " + " ".join(f"WHEN {k} THEN '{p}'" for k, (_, p) in enumerate(_FOLDERS) if p) + " END"
_M2 = f"m2 AS (SELECT photo_id, ts, folder, {_PREC} AS precision, CASE {_PREC} WHEN 'year' THEN strftime(ts, '%Y') WHEN 'month' THEN strftime(ts, '%Y-%m') WHEN 'day' THEN strftime(ts, '%Y-%m-%d') END AS local FROM foldered)"


@query("m2_folder_date", "WITH " + _FOLDER + "," + _M2 + " SELECT DISTINCT folder, local, precision FROM m2")
def m2(spark, sf):
    f = a.table(spark, sf, "events").select(_foldered(F.col("ts")).alias("folder")).distinct()
    return dates.folder_dates(f, THIS_YEAR).select("folder", "folder_date.local", "folder_date.precision")


@query("m3_nearest_folder", "WITH " + _FOLDER + "," + _M2 + " SELECT photo_id, CASE WHEN precision IS NULL AND photo_id % 12 IN (5, 9) THEN strftime(ts, '%Y') ELSE local END AS local FROM m2")
def m3(spark, sf):
    """The file lies two undated folders below."""
    e = a.table(spark, sf, "events").withColumn("path", F.concat(_foldered(F.col("ts")), F.lit("/raw/best/a.jpg")))
    return dates.nearest_folder_dates(e, THIS_YEAR).select(F.col("event_id").alias("photo_id"), "folder_date.local")


_SHOTS = """shots AS (SELECT event_id AS photo_id, CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2001-01-01' WHEN event_id % 4 = 2 THEN TIMESTAMP '1985-06-01' END WHEN event_id % 6 < 3 THEN date_trunc('second', ts) END AS exif,
  CASE WHEN event_id % 10 = 3 THEN date_trunc('second', ts) + INTERVAL 30 DAY WHEN event_id % 10 = 4 THEN date_trunc('second', ts) END AS gps, CASE WHEN event_id % 14 = 5 THEN date_trunc('second', ts) - INTERVAL 1 HOUR END AS container,
  CASE WHEN event_id % 9 <> 8 THEN date_trunc('second', ts) + INTERVAL 1 SECOND * (event_id % 5) * 40000 END AS mtime, ts FROM events)"""


def shots(spark, sf):
    """Photos with header times (some impossible), GPS, container time, modification time and a path."""
    e = spread(a.table(spark, sf, "events").select("event_id", "ts"))
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts")).cast("timestamp")
    ns = lambda c: F.unix_micros(c) * 1000
    exif = F.when(i % 6 == 0, F.when(i % 4 == 0, F.lit("2001-01-01").cast("timestamp")).when(i % 4 == 2, F.lit("1985-06-01").cast("timestamp"))).when(i % 6 < 3, ts)
    return e.select(
        i.alias("photo_id"), ns(exif).alias("exif_ns"), (i % 2 == 0).alias("offset_known"),
        F.when(i % 10 == 3, ns(ts) + 30 * dates.DAY).when(i % 10 == 4, ns(ts)).alias("gps_ns"), F.when(i % 14 == 5, ns(ts) - 3600 * dates.SECOND).alias("container_ns"),
        F.when(i % 9 != 8, ns(ts) + (i % 5) * 40000 * dates.SECOND).alias("mtime_ns"), F.concat(_foldered(F.col("ts")), F.lit("/"), _formed(F.col("ts"))).alias("path"),
        F.when(i % 17 == 3, "shift").when(i % 17 == 4, "use_name").when(i % 17 == 5, "use_folder").alias("correction"), F.lit(None).cast("struct<ns:bigint,local:string,precision:string>").alias("set_date"), F.lit(-93_600).cast("long").alias("shift_s"),
    )


@query("m4_plausible", "WITH " + _SHOTS + f" SELECT photo_id, year(exif) >= 1990 AND epoch(exif) <= {NOW_NS // 10**9} + 86400 AND exif NOT IN (TIMESTAMP '1970-01-01', TIMESTAMP '1980-01-01', TIMESTAMP '2000-01-01', TIMESTAMP '2001-01-01') AS plausible FROM shots WHERE exif IS NOT NULL")
def m4(spark, sf):
    return shots(spark, sf).where("exif_ns is not null").select("photo_id", dates.plausible(dates.instant(F.col("exif_ns")), NOW_NS).alias("plausible"))


_E = lambda c: f"CAST(epoch({c}) AS BIGINT) * 1000000000"
_END = "CASE {1} WHEN 'day' THEN {0} + 86400000000000 WHEN 'month' THEN CAST(epoch(make_timestamp({0} // 1000) + INTERVAL 1 MONTH) AS BIGINT) * 1000000000 WHEN 'year' THEN CAST(epoch(make_timestamp({0} // 1000) + INTERVAL 1 YEAR) AS BIGINT) * 1000000000 ELSE {0} END"
_OK = f"({{0}} >= 631152000000000000 AND {{0}} <= {NOW_NS} + 86400000000000 AND NOT ({{1}} = 'second' AND {{0}} IN (946684800000000000, 978307200000000000)))"
_M5 = "WITH " + _NAMED + "," + _M1 + "," + _FOLDER + "," + _M2 + "," + _SHOTS + f""",
  near AS (SELECT photo_id, fp, CAST(epoch(date_trunc(coalesce(fp, 'day'), ts)) AS BIGINT) * 1000000000 AS fns FROM (SELECT *, CASE WHEN precision IS NULL AND photo_id % 12 IN (5, 9) THEN 'year' ELSE precision END AS fp FROM m2)),
  cands AS (
    SELECT photo_id, 1 AS k, 'exif' AS source, {_E("exif")} AS ns, 'second' AS precision FROM shots WHERE exif IS NOT NULL UNION ALL SELECT photo_id, 2, 'gps', {_E("gps")}, 'second' FROM shots WHERE gps IS NOT NULL
    UNION ALL SELECT photo_id, 3, 'container', {_E("container")}, 'second' FROM shots WHERE container IS NOT NULL UNION ALL SELECT photo_id, 4, 'file_name', ns, precision FROM m1 WHERE ns IS NOT NULL
    UNION ALL SELECT photo_id, 5, 'folder_name', fns, fp FROM near WHERE fp IS NOT NULL UNION ALL SELECT photo_id, 6, 'mtime', {_E("mtime")}, 'second' FROM shots WHERE mtime IS NOT NULL),
  marked AS (SELECT *, {_OK.format("ns", "precision")} AS plausible FROM cands),
  chosen AS (SELECT photo_id, k, source, ns, precision FROM marked WHERE plausible OR k = 6 QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY NOT plausible, k) = 1),
  first AS (SELECT c.photo_id, c.source, c.ns, c.precision, CASE WHEN r THEN m ELSE ns END AS rns, CASE WHEN r THEN 'second' ELSE precision END AS rp FROM (SELECT c.*, {_E("s.mtime")} AS m,
      coalesce(c.source IN ('file_name', 'folder_name') AND c.precision <> 'second' AND {_E("s.mtime")} >= c.ns AND {_E("s.mtime")} < {_END.format("c.ns", "c.precision")}, false) AS r FROM chosen c JOIN shots s USING (photo_id)) c),
  fixed AS (SELECT s.photo_id, CASE WHEN s.photo_id % 17 = 3 AND (e.ns IS NOT NULL OR c.ns IS NOT NULL) THEN 'shift' WHEN s.photo_id % 17 = 4 AND n.ns IS NOT NULL THEN 'use' WHEN s.photo_id % 17 = 5 AND f.ns IS NOT NULL THEN 'use' END AS fix,
      CASE WHEN s.photo_id % 17 = 3 THEN 'owner' WHEN s.photo_id % 17 = 4 THEN 'file_name' ELSE 'folder_name' END AS fsource, CASE WHEN s.photo_id % 17 = 3 THEN coalesce(e.ns, c.rns) WHEN s.photo_id % 17 = 4 THEN n.ns ELSE f.ns END AS xns,
      CASE WHEN s.photo_id % 17 = 3 THEN CASE WHEN e.ns IS NOT NULL THEN 'second' ELSE c.rp END WHEN s.photo_id % 17 = 4 THEN n.precision ELSE f.precision END AS xp, c.source, c.ns, c.precision
    FROM shots s LEFT JOIN first c USING (photo_id) LEFT JOIN marked e ON e.photo_id = s.photo_id AND e.k = 1 LEFT JOIN marked n ON n.photo_id = s.photo_id AND n.k = 4 LEFT JOIN marked f ON f.photo_id = s.photo_id AND f.k = 5),
  eff AS (SELECT photo_id, CASE WHEN fix IS NULL THEN source ELSE fsource END AS source, CASE WHEN fix IS NULL THEN precision ELSE xp END AS precision,
      CASE WHEN fix = 'shift' THEN CASE xp WHEN 'second' THEN xns - 93600000000000 ELSE CAST(epoch(date_trunc(xp, make_timestamp((xns - 93600000000000) // 1000))) AS BIGINT) * 1000000000 END WHEN fix = 'use' THEN xns ELSE ns END AS ns FROM fixed),
  refd AS (SELECT e.photo_id, e.source, {_E("s.mtime")} AS mns, coalesce(e.source IN ('file_name', 'folder_name') AND e.precision <> 'second' AND {_E("s.mtime")} >= e.ns AND {_E("s.mtime")} < {_END.format("e.ns", "e.precision")}, false) AS refined, e.ns, e.precision FROM eff e JOIN shots s USING (photo_id))"""
_CONF = "CASE source WHEN 'exif' THEN CASE WHEN photo_id % 2 = 0 THEN 'high' ELSE 'medium' END WHEN 'gps' THEN 'high' WHEN 'container' THEN 'medium' WHEN 'mtime' THEN 'lowest' WHEN 'owner' THEN 'medium' ELSE CASE WHEN refined THEN 'medium' ELSE 'low' END END"


@query("m18_entry_dates", _M5 + " SELECT photo_id, source, ns, plausible FROM marked")
def m18(spark, sf):
    c = dates.candidates(shots(spark, sf), NOW_NS, THIS_YEAR)
    return c.select("photo_id", F.explode("candidates").alias("c")).select("photo_id", "c.source", "c.date.ns", "c.plausible")


def _no_fix(spark, sf):
    return shots(spark, sf).withColumn("correction", F.lit(None).cast("string"))


@query("m5_derive", _M5.replace("fixed AS (SELECT s.photo_id, CASE WHEN", "fixed AS (SELECT s.photo_id, CASE WHEN false AND s.photo_id < 0 THEN '' WHEN 1 = 2 AND").replace(" WHEN s.photo_id % 17 = 4 AND n.ns IS NOT NULL THEN 'use' WHEN s.photo_id % 17 = 5 AND f.ns IS NOT NULL THEN 'use' END AS fix", " END AS fix")
       + f" SELECT photo_id, source, CASE WHEN refined THEN mns ELSE ns END AS ns, CASE WHEN source IS NOT NULL THEN refined END AS refined, CASE WHEN source IS NOT NULL THEN {_CONF} END AS confidence FROM refd")
def m5(spark, sf):
    d = dates.derive(_no_fix(spark, sf), NOW_NS, THIS_YEAR)
    return d.select("photo_id", "effective.source", "effective.date.ns", "effective.refined", "effective.confidence")


@query("m6_corrections", _M5 + f" SELECT photo_id, source, CASE WHEN refined THEN mns ELSE ns END AS ns, CASE WHEN source IS NOT NULL THEN {_CONF} END AS confidence FROM refd")
def m6(spark, sf):
    d = dates.derive(shots(spark, sf), NOW_NS, THIS_YEAR)
    return d.select("photo_id", "effective.source", "effective.date.ns", "effective.confidence")


@query(
    "m7_flags",
    _M5
    + f""", h AS (SELECT photo_id, count(*) AS n, count(*) FILTER (NOT plausible) AS bad FROM marked WHERE k < 4 GROUP BY 1)
    SELECT r.photo_id, CAST(CASE WHEN source IN ('exif','gps','container','owner') AND mns IS NOT NULL AND greatest(ns - mns, mns - {_END.format("ns", "precision")}) > 86400000000000 THEN 1 ELSE 0 END
      + CASE WHEN coalesce(bad, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN n IS NULL THEN 8 ELSE 0 END AS INTEGER) AS flags FROM refd r LEFT JOIN h USING (photo_id)""",
)
def m7(spark, sf):
    return dates.derive(shots(spark, sf), NOW_NS, THIS_YEAR).select("photo_id", "flags")


@query("m16_inputs_key", "SELECT event_id AS photo_id, event_id % 3 = 0 AS changed FROM events")
def m16(spark, sf):
    """Which photos need a new derivation after the modification time of every third has moved."""
    key = lambda m: dates.inputs_key(F.col("path"), F.col("exif_ns"), F.col("gps_ns"), F.col("container_ns"), m, F.col("correction"))
    m = F.coalesce("mtime_ns", F.lit(0))
    moved = m + F.when(F.col("photo_id") % 3 == 0, 1).otherwise(0)
    return shots(spark, sf).select("photo_id", (key(m) != key(moved)).alias("changed"))


@query("f18_media_filter", _P + " SELECT photo_id FROM photos_events WHERE camera = 'cam3' AND kind = 'click' AND folder >= '2024-01-10'")
def f18(spark, sf):
    return a.photos_events(spark, sf).where("camera = 'cam3' and kind = 'click' and folder >= '2024-01-10'").select("photo_id")


@query("m8_camera_key", "SELECT event_id AS photo_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE trim(event_type) || '|' || 'A/' || (user_id % 7) || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END END AS camera_key FROM events")
def m8(spark, sf):
    none = F.col("event_id") % 5 == 0
    make = F.when(none, F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit("\x00 ")))
    model = F.when(~none, F.concat(F.lit("A|"), (F.col("user_id") % 7).cast("string")))
    serial = F.when(~none & (F.col("event_id") % 3 != 0), F.col("user_id").cast("string"))
    return a.table(spark, sf, "events").select(F.col("event_id").alias("photo_id"), dates.camera_key(make, model, serial).alias("camera_key"))


@query("m9_events", _P + " SELECT folder, count(DISTINCT camera) AS cameras, count(*) AS photos FROM photos_events GROUP BY 1 HAVING count(DISTINCT camera) >= 2")
def m9(spark, sf):
    return dates.events(a.photos_events(spark, sf))


#: Shots of seven cameras in day folders.  Camera 3 is 26 h ahead; camera 5's clock is 20 h off at times; some carry GPS.
_CAMS = """cams AS (SELECT event_id AS photo_id, CAST(date_trunc('day', ts) AS DATE) AS day, strftime(ts, '%Y-%m-%d') AS folder, 'cam' || (user_id % 7) AS camera, date_trunc('second', ts) AS t,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CASE WHEN user_id % 7 = 3 THEN 200000 WHEN user_id % 7 = 5 AND day(ts) % 3 = 0 THEN 300000 + day(ts) * 1000 ELSE 0 END AS cap,
    CASE WHEN user_id % 7 = 1 OR (user_id % 7 = 6 AND day(ts) % 4 = 1) THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CASE WHEN user_id % 7 = 6 THEN 100000 ELSE 0 END END AS gps, user_id % 2 = 0 AS offset_known FROM events WHERE {where})"""
_CANDS = """ev AS (SELECT folder FROM cams GROUP BY 1 HAVING count(DISTINCT camera) >= 2),
 own AS (SELECT folder, camera, count(*) AS n, median(cap - gps) AS m, min(cap - gps) AS lo, max(cap - gps) AS hi, bool_and(offset_known) AS known FROM cams JOIN ev USING (folder) WHERE gps IS NOT NULL GROUP BY ALL),
 owngps AS (SELECT folder, camera, CAST(m AS BIGINT) AS delta, 'own_gps' AS reference FROM own WHERE n >= 3 AND hi - lo <= 600 AND abs(m) > CASE WHEN known THEN 3600 ELSE 50400 END),
 per AS (SELECT folder, camera, min(cap) AS lo, max(cap) AS hi, list_sort(list(cap)) AS caps FROM cams JOIN ev USING (folder) GROUP BY ALL),
 oth AS (SELECT p.folder, p.camera, min(c.cap) AS olo, max(c.cap) AS ohi, list_sort(list(c.cap)) AS ocaps, count(c.gps) AS g, count(*) FILTER (c.gps IS NOT NULL AND abs(c.cap - c.gps) > 600) AS far,
    count(*) FILTER (NOT (c.cap >= epoch(c.day) AND c.cap < epoch(c.day) + 86400)) AS out FROM per p JOIN cams c ON c.folder = p.folder AND c.camera <> p.camera GROUP BY ALL),
 mine AS (SELECT folder, camera, count(*) FILTER (cap >= epoch(day) AND cap < epoch(day) + 86400) AS inn FROM cams GROUP BY ALL),
 rng AS (SELECT p.folder, p.camera, ((caps[(len(caps) + 1) // 2] * 1000000000 + ((caps[len(caps) // 2 + 1] - caps[(len(caps) + 1) // 2]) * 1000000000) // 2) - (ocaps[(len(ocaps) + 1) // 2] * 1000000000 + ((ocaps[len(ocaps) // 2 + 1] - ocaps[(len(ocaps) + 1) // 2]) * 1000000000) // 2)) AS dns,
    CASE WHEN g > 0 AND far = 0 THEN 'gps' WHEN out = 0 AND inn = 0 THEN 'folder_name' ELSE 'none' END AS reference
   FROM per p JOIN oth USING (folder, camera) JOIN mine USING (folder, camera) WHERE hi - lo < 86400 AND (hi < olo - 21600 OR lo > ohi + 21600)),
 cand AS (SELECT * FROM owngps UNION ALL SELECT folder, camera, CAST(sign(dns) * ((abs(dns) + 500000000) // 1000000000) AS BIGINT), reference FROM rng WHERE (folder, camera) NOT IN (SELECT folder, camera FROM owngps))"""


def cams(spark, sf):
    e = a.table(spark, sf, "events")
    t, u, day = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp")), F.col("user_id") % 7, F.dayofmonth("ts")
    off = F.when(u == 3, 200_000).when((u == 5) & (day % 3 == 0), 300_000 + day * 1000).otherwise(0)
    gps = F.when((u == 1) | ((u == 6) & (day % 4 == 1)), t + F.when(u == 6, 100_000).otherwise(0))
    folder = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        F.col("event_id").alias("photo_id"), folder.alias("folder"), F.concat(F.lit("cam"), u.cast("string")).alias("camera"), ((t + off) * dates.SECOND).alias("capture_ns"), (gps * dates.SECOND).alias("gps_ns"),
        (F.col("user_id") % 2 == 0).alias("offset_known"), dates.leading_date(folder).alias("folder_day"),
    )


_C = "WITH " + _CAMS.format(where="true") + "," + _CANDS


@query("m11_own_gps", _C + " SELECT folder, camera, delta FROM owngps")
def m11(spark, sf):
    return dates.own_gps(cams(spark, sf))


@query("m10_candidates", _C + " SELECT folder, camera, delta, reference FROM cand")
def m10(spark, sf):
    return dates.offset_candidates(cams(spark, sf))


_JUDGE = """judged AS (SELECT camera, max(delta) - min(delta) AS spread, bool_or(reference IN ('gps', 'own_gps')) OR (count(*) >= 2 AND bool_or(reference = 'folder_name')) AS backed, list_sort(list(delta)) AS ds FROM cand GROUP BY 1),
 off AS (SELECT camera, -(ds[(len(ds) + 1) // 2] + (ds[len(ds) // 2 + 1] - ds[(len(ds) + 1) // 2]) // 2) AS s FROM judged WHERE spread <= 600 AND backed)"""


@query(
    "m12_offset",
    _C + "," + _JUDGE + ", cams1 AS (SELECT * FROM cams WHERE camera NOT IN (SELECT camera FROM off))," + _CANDS.replace("cams", "cams1").replace("ev", "ev1").replace("owngps", "og1").replace("own AS", "own1 AS").replace("FROM own ", "FROM own1 ").replace("per ", "per1 ").replace("oth ", "oth1 ").replace("mine ", "mine1 ").replace("rng ", "rng1 ").replace("cand AS", "cand1 AS").replace("'own_gps'", "'own_gps'")
    + """ SELECT c.camera, count(*) AS photos, CASE WHEN any_value(o.s) IS NOT NULL THEN 'offset' WHEN c.camera IN (SELECT camera FROM cand1) THEN 'disagrees' ELSE 'ok' END AS state,
      CAST(any_value(sign(o.s) * ((abs(o.s) + 30) // 60)) * 60 AS BIGINT) AS shift_s FROM cams c LEFT JOIN off o USING (camera) GROUP BY 1""",
)
def m12(spark, sf):
    return dates.detect(cams(spark, sf))


#: As ``cams``, with photos that the owner dated (left out) and some moved by a minute.
_SHIFTED = "WITH " + _CAMS.format(where="event_id % 31 <> 7").replace("cams AS", "cams0 AS", 1) + ", cams AS (SELECT * REPLACE (cap - CASE WHEN photo_id % 29 = 3 THEN 60 ELSE 0 END AS cap) FROM cams0)," + _CANDS + "," + _JUDGE


def _corrected(spark, sf):
    i = F.col("photo_id")
    fixed = F.when(i % 31 == 7, "set").when(i % 29 == 3, "shift")
    return cams(spark, sf).withColumns({"correction": fixed, "shift_s": F.lit(-60).cast("long")})


@query("j13_camera_flags", _SHIFTED + " SELECT photo_id, CASE WHEN camera IN (SELECT camera FROM off) AND (folder, camera) IN (SELECT folder, camera FROM cand) THEN 12 ELSE 8 END AS flags FROM cams")
def j13(spark, sf):
    """The camera bit on photos that offset cameras took at the events; another bit is there already."""
    photos = dates.camera_shots(_corrected(spark, sf), NOW_NS + 90 * dates.DAY)
    cameras, events = dates.detection(photos)
    return dates.camera_flags(photos.select("photo_id", F.lit(8).alias("flags")), photos, cameras, events)


@query(
    "m19_cameras_read",
    "WITH " + _CAMS.format(where="true") + "," + _CANDS + "," + _JUDGE
    + """, shown AS (SELECT camera, count(*) AS photos FROM cams GROUP BY 1), now AS (SELECT * FROM cams WHERE camera <> 'cam2' AND day(day) % 5 <> 3)
    SELECT s.camera, s.photos, o.s IS NOT NULL AS is_off, e.folder, e.delta, e.reference FROM shown s LEFT JOIN off o USING (camera) LEFT JOIN (SELECT * FROM cand WHERE camera IN (SELECT camera FROM off) AND folder IN (SELECT folder FROM now)) e USING (camera)
    WHERE s.camera IN (SELECT camera FROM now)""",
)
def m19(spark, sf):
    """Offset cameras with their events after one camera's photos and every fifth day's folder have gone."""
    photos = cams(spark, sf)
    cameras, events = dates.detection(photos)
    events = events.join(cameras.where("state = 'offset'").select("camera"), "camera", "left_semi")
    now = photos.where((F.col("camera") != "cam2") & (F.substring("folder", 9, 2).cast("int") % 5 != 3))
    read = dates.cameras_read(cameras, events, now)
    return read.select("camera", "photos", (F.col("state") == "offset").alias("is_off"), "folder", "delta", "reference")


@query("m17_rederive", _M5 + f" SELECT photo_id, source, CASE WHEN refined THEN mns ELSE ns END AS ns, CASE WHEN source IS NOT NULL THEN {_CONF} END AS confidence FROM refd WHERE photo_id % 13 <> 1")
def m17(spark, sf):
    """Dates stored before a third of the times moved and some photos came and went, brought up to date."""
    i, now = F.col("photo_id"), shots(spark, sf)
    before = now.where(i % 17 != 2).withColumn("mtime_ns", F.when(i % 3 == 0, F.col("mtime_ns") - dates.DAY).otherwise(F.col("mtime_ns")))
    none = spark.createDataFrame([], "photo_id long, inputs_key long, flags int")
    none = none.withColumn("effective", F.lit(None).cast(dates.EFFECTIVE))
    stored = checkpoint(dates.rederive(none, before, NOW_NS, THIS_YEAR))
    d = dates.rederive(stored, now.where(i % 13 != 1), NOW_NS, THIS_YEAR)
    return d.select("photo_id", "effective.source", "effective.date.ns", "effective.confidence")


@query("m14_template", "WITH " + _FOLDER + "," + _M2 + " SELECT DISTINCT folder, CASE photo_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Trip' WHEN 2 THEN 'x' WHEN 3 THEN string_split(folder, '/')[2] WHEN 4 THEN string_split(folder, '/')[3] WHEN 5 THEN string_split(folder, '/')[2] WHEN 9 THEN '13' WHEN 10 THEN string_split(folder, '/')[2] WHEN 8 THEN '' ELSE folder END AS event FROM m2")
def m14(spark, sf):
    """The event name of each folder: its last part without a leading date."""
    f = a.table(spark, sf, "events").select(_foldered(F.col("ts")).alias("folder")).distinct()
    return f.select("folder", dates.event_name(F.substring_index("folder", "/", -1)).alias("event"))


@query("m15_rename", "WITH " + _NAMED + " SELECT photo_id, CASE WHEN photo_id % 11 = 6 AND false THEN name ELSE strftime(ts, '%Y%m%d_%H%M%S_') || name END AS renamed FROM named WHERE photo_id % 2 = 0")
def m15(spark, sf):
    """By the time taken; a name that starts so already would be kept, and a date coarser than a second names nothing."""
    e = a.table(spark, sf, "events").withColumn("name", _formed(F.col("ts")))
    second = dates.instant(F.unix_micros(F.date_trunc("second", F.col("ts")).cast("timestamp")) * 1000)
    day = F.struct(F.lit(0).cast("long").alias("ns"), F.date_format("ts", "yyyy-MM-dd").alias("local"), F.lit("day").alias("precision"))
    date = F.when(F.col("event_id") % 2 == 0, second).otherwise(day)
    return e.select(F.col("event_id").alias("photo_id"), dates.renamed(F.col("name"), date).alias("renamed")).where("renamed is not null")


@query("o11_media_page", _P + " SELECT photo_id, capture_s FROM photos_events ORDER BY capture_s, photo_id LIMIT 100")
def o11(spark, sf):
    return a.photos_events(spark, sf).select("photo_id", "capture_s").orderBy(F.asc_nulls_last("capture_s"), "photo_id").limit(100)


@query("o14_camera_order", _P + " SELECT camera, count(*) AS photos, row_number() OVER (ORDER BY CASE WHEN camera = 'cam3' THEN 0 ELSE 1 END, count(*) DESC, camera) AS place FROM photos_events GROUP BY 1")
def o14(spark, sf):
    from pyspark.sql import Window

    per = a.photos_events(spark, sf).groupBy("camera").agg(F.count(F.lit(1)).alias("photos"))
    order = Window.orderBy(F.when(F.col("camera") == "cam3", 0).otherwise(1), F.desc("photos"), "camera")
    return per.withColumn("place", F.row_number().over(order).cast("long"))


@query("s9_tail", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 200")
def s9(spark, sf):
    return a.table(spark, sf, "events").where("event_id > 5000").orderBy("event_id").limit(200).select("event_id", "event_type")


@query("t7_prune", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def t7(spark, sf):
    e = a.table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 7 days")).select("event_id")
