"""Dates of photos: from names, folders and headers, by precedence, and clocks that are off.

A date is a struct ``ns`` (start of its period, UTC nanoseconds), ``local`` (4, 7, 10
or 19 letters) and ``precision`` (year, month, day, second).  Wall times are read in
UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import parent, with_ancestors
from granary.functions.runs import checkpoint, spread

FIRST_YEAR = 1990
SECOND = 1_000_000_000
DAY = 86_400 * SECOND
#: A clock that was never set starts here.
CAMERA_DEFAULTS = (1970, 1980, 2000, 2001)
#: Years a written date can have.
YEARS = (1700, 2200)
#: Flag bits.
MTIME_DISAGREES, IMPLAUSIBLE, CAMERA_OFFSET, NO_DATE_METADATA = 1, 2, 4, 8


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date(digits: Column, precision: Column, millis: Column | None = None) -> Column:
    """The date that 14 digits name, null where there is none."""
    length = F.when(precision == "year", 4).when(precision == "month", 7).when(precision == "day", 10).otherwise(19)

    def of(at: Column) -> Column:
        ns = F.unix_micros(at) * 1000 + (F.coalesce(millis, F.lit(0)) * 1_000_000 if millis is not None else 0)
        local = F.substring(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(1), length)
        return F.when(F.year(at).between(*YEARS), F.struct(ns.alias("ns"), local.alias("local"), precision.alias("precision")))

    return _once(F.try_to_timestamp(F.when(F.length(digits) == 14, digits), F.lit("yyyyMMddHHmmss")), of)


#: Shapes of dated file names, of the lower-case name; the first that fits decides.  Each has another number of digits by its
#: precision: 8 for a day, 14 for a second, 17 with thousandths.
_NAMES = (
    r"(?:img|vid)_\d{8}_\d{6}(?!\d)",
    r"pxl_\d{8}_\d{9}(?!\d)",
    r"(?:img|vid)-\d{8}-wa",
    r"screenshot_\d{4}-\d\d-\d\d-\d\d-\d\d-\d\d(?!\d)",
    r"screenshot_\d{8}-\d{6}(?!\d)",
    r"screenshot_\d{4}-\d\d-\d\d(?!\d)",
    r"\d{8}_\d{6}(?!\d)",
    r"\d{4}-\d\d-\d\d \d\d\.\d\d\.\d\d(?!\d)",
)


def name_date(file_name: Column) -> Column:
    """The date at the start of a camera's, phone's or chat program's file name (M1)."""
    s = F.translate(file_name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_replace(F.regexp_extract(s, f"^(?:{'|'.join(_NAMES)})", 0), r"\D", "")

    def of(digits: Column) -> Column:
        day = F.length(digits) == 8
        millis = F.when(F.length(digits) == 17, F.substring(digits, 15, 3).cast("long"))
        return _date(F.when(day, F.concat(digits, F.lit("000000"))).otherwise(F.substring(digits, 1, 14)), F.when(day, "day").otherwise("second"), millis)

    return _once(found, of)


_SEP = r"(?=$|[ \-_.])"
#: Dates at the start of a folder's name, before its end or one of space, ``-``, ``_``, ``.``.
_LEADING = ((rf"^\d{{4}}-\d\d-\d\d{_SEP}", "000000", "day"), (rf"^\d{{4}}-\d\d{_SEP}", "01000000", "month"), (rf"^\d{{4}}{_SEP}", "0101000000", "year"))


def leading_date(folder: Column) -> Column:
    """The date that a folder's name begins with; of the forms the first that names a real one."""
    found = []
    for pattern, tail, p in _LEADING:
        digits = F.regexp_replace(F.regexp_extract(folder, pattern, 0), r"\D", "")
        found.append(_date(F.concat(digits, F.lit(tail)), F.lit(p)))
    return F.coalesce(*found)


def folder_dates(folders: DataFrame, this_year: int) -> DataFrame:
    """Adds ``folder_date`` to folders (``folder``: a path), read with the two folders above (M2).

    First nested year/month/day, then year/month, else the date of its own name.
    ``05-07-2010`` may be day first, so it is no month below a year.
    """
    parts = F.split("folder", "/", -1)
    at = lambda k: F.when(F.size(parts) > k, F.get(parts, F.size(parts) - 1 - k))
    out = folders.withColumns({"granary_own": at(0), "granary_up": at(1), "granary_top": at(2)})
    year = lambda c: F.col(c).rlike(r"^\d{4}$") & F.col(c).try_cast("int").between(FIRST_YEAR, this_year)
    two = lambda c: F.regexp_extract(c, rf"^(\d\d){_SEP}", 1)
    month = lambda c: F.when(~F.col(c).rlike(r"^\d\d[\-_.](0\d|1[0-2])"), F.nullif(two(c), F.lit("")))
    out = out.withColumns(
        {
            "granary_day": F.when(year("granary_top"), F.concat("granary_top", month("granary_up"), F.nullif(two("granary_own"), F.lit("")), F.lit("000000"))),
            "granary_month": F.when(year("granary_up"), F.concat("granary_up", month("granary_own"), F.lit("01000000"))),
            "granary_lead": leading_date(F.col("granary_own")),
        }
    )
    own = F.when(F.substring("granary_lead.local", 1, 4).cast("int").between(FIRST_YEAR, this_year), F.col("granary_lead"))
    out = out.withColumn("folder_date", F.coalesce(_date(F.col("granary_day"), F.lit("day")), _date(F.col("granary_month"), F.lit("month")), own))
    return out.drop("granary_own", "granary_up", "granary_top", "granary_day", "granary_month", "granary_lead")


def nearest_folder_dates(rows: DataFrame, this_year: int) -> DataFrame:
    """Adds ``folder_date``: that of the nearest dated folder above each ``path`` (M3).

    Folders are far fewer than files: each is dated once, and every folder
    takes the deepest date at or above it.
    """
    folders = rows.select(parent(F.col("path")).alias("folder")).where("folder <> ''").distinct()
    every = with_ancestors(folders.select(F.concat("folder", F.lit("/x")).alias("path"), "folder"), False)
    dated = folder_dates(every.select(F.col("ancestor").alias("at")).distinct().withColumnRenamed("at", "folder"), this_year).where("folder_date is not null")
    near = (
        every.select("folder", "ancestor", "level").join(dated.select(F.col("folder").alias("ancestor"), "folder_date"), "ancestor")
        .groupBy("folder").agg(F.max_by("folder_date", "level").alias("folder_date"))
    )
    near = near.withColumnRenamed("folder", "granary_folder")
    return rows.join(near, parent(F.col("path")) == F.col("granary_folder"), "left").drop("granary_folder")


def plausible(date: Column, now_ns: int) -> Column:
    """From FIRST_YEAR on, not after tomorrow, and not the first midnight of a camera's default year (M4)."""
    default = F.lit(False)
    for y in CAMERA_DEFAULTS:
        default = default | (date["local"] == f"{y}-01-01T00:00:00")
    return (F.substring(date["local"], 1, 4).cast("int") >= FIRST_YEAR) & (date["ns"] <= now_ns + DAY) & ~((date["precision"] == "second") & default)


def instant(ns: Column) -> Column:
    """An instant as a date of second precision; null stays null."""
    at = F.timestamp_micros(F.floor(ns / 1000).cast("long"))
    return F.when(ns.isNotNull(), F.struct(ns.cast("long").alias("ns"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("local"), F.lit("second").alias("precision")))


def end_ns(date: Column) -> Column:
    """Where a date's period ends."""
    start = F.timestamp_micros(F.floor(date["ns"] / 1000).cast("long"))
    months = F.when(date["precision"] == "year", 12).when(date["precision"] == "month", 1).otherwise(0)
    later = F.unix_micros(F.add_months(start, months).cast("timestamp")) * 1000
    return F.when(date["precision"] == "second", date["ns"] + SECOND).when(date["precision"] == "day", date["ns"] + DAY).otherwise(later)


def contains(date: Column, ns: Column, slack: int = 0) -> Column:
    return (ns >= date["ns"] - slack) & (ns < end_ns(date) + slack)


def candidates(rows: DataFrame, now_ns: int, this_year: int) -> DataFrame:
    """Adds ``candidates``: source, date and plausibility in order of trust.

    ``rows``: ``path``, ``exif_ns``, ``offset_known``, ``gps_ns``, ``container_ns``, ``mtime_ns``; any may be null.
    """
    file_name = F.substring_index("path", "/", -1)
    dates = {
        "exif": instant(F.col("exif_ns")), "gps": instant(F.col("gps_ns")), "container": instant(F.col("container_ns")),
        "file_name": name_date(file_name), "folder_name": F.col("folder_date"), "mtime": instant(F.col("mtime_ns")),
    }
    # Each date is a column before it is used: an expression used ten times would be computed ten times.
    at = {s: F.col(f"granary_{s}") for s in dates}
    listed = [F.when(d.isNotNull(), F.struct(F.lit(s).alias("source"), d.alias("date"), plausible(d, now_ns).alias("plausible"))) for s, d in at.items()]
    # Reading dates takes most of the time, and a few large files are a few tasks.
    out = spread(nearest_folder_dates(rows, this_year)).withColumns({f"granary_{s}": d for s, d in dates.items()}).withColumn("candidates", F.filter(F.array(*listed), lambda c: c.isNotNull()))
    return out.drop("folder_date", *(f"granary_{s}" for s in dates))


#: The effective date of a photo.
EFFECTIVE = "struct<source:string,date:struct<ns:bigint,local:string,precision:string>,confidence:string,refined:boolean>"


def _take(candidate: Column, slack: int) -> Column:
    """A candidate as the effective date: one coarser than a second that holds the modification time is refined by it."""
    source, date, mtime = candidate["source"], candidate["date"], F.col("mtime_ns")
    named = source.isin("file_name", "folder_name")
    refined = F.coalesce(named & (date["precision"] != "second") & contains(date, mtime, slack), F.lit(False))
    confidence = (
        F.when(source == "exif", F.when(F.coalesce("offset_known", F.lit(False)), "high").otherwise("medium"))
        .when(source == "gps", "high").when(source == "container", "medium")
        .when(named, F.when(refined, "medium").otherwise("low")).otherwise("lowest")
    )
    return F.when(candidate.isNotNull(), F.struct(source.alias("source"), F.when(refined, instant(mtime)).otherwise(date).alias("date"), confidence.alias("confidence"), refined.alias("refined")))


def _owner(date: Column, confidence: str) -> Column:
    return F.when(date.isNotNull(), F.struct(F.lit("owner").alias("source"), date.alias("date"), F.lit(confidence).alias("confidence"), F.lit(False).alias("refined")))


def shifted(date: Column, seconds: Column) -> Column:
    """A date moved by seconds; one coarser than a second starts its new period."""
    moved = F.timestamp_micros(F.floor(date["ns"] / 1000).cast("long") + seconds * 1_000_000)
    start = F.when(date["precision"] == "year", F.date_trunc("year", moved)).when(date["precision"] == "month", F.date_trunc("month", moved)).when(date["precision"] == "day", F.date_trunc("day", moved))
    local = F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss")
    length = F.when(date["precision"] == "year", 4).when(date["precision"] == "month", 7).when(date["precision"] == "day", 10).otherwise(19)
    ns = F.when(date["precision"] == "second", date["ns"] + seconds * SECOND).otherwise(F.unix_micros(start) * 1000)
    return F.when(F.year(moved).between(*YEARS), F.struct(ns.alias("ns"), F.substring(local, F.lit(1), length).alias("local"), date["precision"].alias("precision")))


def derive(rows: DataFrame, now_ns: int, this_year: int, local_time: bool = False) -> DataFrame:
    """Adds ``effective`` (source, date, confidence, refined) and ``flags`` (M5-M7).

    The first plausible candidate, or the modification time however implausible.
    ``correction`` (null, set, shift, use_name, use_folder) with ``set_date`` and
    ``shift_s`` goes before.
    """
    slack = 3600 * SECOND if local_time else 0
    c = candidates(rows, now_ns, this_year)
    by = lambda s: F.get(F.filter("candidates", lambda x: x["source"] == s), F.lit(0))
    best = F.coalesce(F.get(F.filter("candidates", lambda x: x["plausible"]), F.lit(0)), by("mtime"))
    c = c.withColumns({"granary_best": best, "granary_exif": by("exif"), "granary_name": by("file_name"), "granary_folder": by("folder_name")})
    c = c.withColumn("granary_first", _take(F.col("granary_best"), slack))
    c = c.withColumn("granary_base", F.coalesce(F.col("granary_exif.date"), F.col("granary_first.date")))
    base = F.col("granary_base")
    kind = F.col("correction")
    own = (
        F.when(kind == "set", _owner(F.col("set_date"), "high")).when(kind == "shift", _owner(shifted(base, F.col("shift_s")), "medium"))
        .when(kind == "use_name", _take(F.col("granary_name"), slack)).when(kind == "use_folder", _take(F.col("granary_folder"), slack))
    )
    c = c.withColumn("effective", F.coalesce(own, "granary_first"))
    header = F.filter("candidates", lambda x: x["source"].isin("exif", "gps", "container"))
    date = F.col("effective.date")
    end = F.when(date["precision"] == "second", date["ns"]).otherwise(end_ns(date))
    far = F.greatest(date["ns"] - F.col("mtime_ns"), F.col("mtime_ns") - end) > DAY + slack
    trusted = F.col("effective.source").isin("exif", "gps", "container", "owner")
    bit = lambda test, b: F.when(F.coalesce(test, F.lit(False)), b).otherwise(0)
    flags = bit(trusted & far, MTIME_DISAGREES) + bit(F.exists(header, lambda x: ~x["plausible"]), IMPLAUSIBLE) + bit(F.size(header) == 0, NO_DATE_METADATA)
    return c.withColumn("flags", flags).drop("granary_first", "granary_best", "granary_base", "granary_exif", "granary_name", "granary_folder")


def inputs_key(*columns: Column) -> Column:
    """A fingerprint of all that a date is derived from: an unchanged one needs no new derivation."""
    return F.xxhash64(*(F.struct(c.isNull(), F.coalesce(c.cast("string"), F.lit(""))) for c in columns))


def camera_key(make: Column, model: Column, serial: Column) -> Column:
    """make|model|serial, each trimmed of blanks and NULs, ``|`` as ``/``; empty without any (M8)."""
    parts = [F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \\x00]+|[ \\x00]+$", ""), "|", "/") for c in (make, model, serial)]
    return F.when(F.concat(*parts) == "", "").otherwise(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]))


def event_name(folder: Column) -> Column:
    """A folder's name without its leading date and the separators after it."""
    d = leading_date(folder)
    rest = F.substring(folder, F.length(d["local"]) + 1, F.length(folder))
    return F.when(d.isNull(), folder).otherwise(F.regexp_replace(rest, r"^[ \-_.]+", ""))


def renamed(file_name: Column, date: Column) -> Column:
    """``YYYYMMDD_HHMMSS_name``; a name that starts so is kept; null for a date coarser than a second."""
    l = date["local"]  # noqa: E741
    cut = lambda a, n: F.substring(l, a, n)
    prefix = F.concat(cut(1, 4), cut(6, 2), cut(9, 2), F.lit("_"), cut(12, 2), cut(15, 2), cut(18, 2), F.lit("_"))
    return F.when(date["precision"] == "second", F.when(file_name.startswith(prefix), file_name).otherwise(F.concat(prefix, file_name)))


def events(photos: DataFrame) -> DataFrame:
    """Folders with photos of two cameras or more (M9)."""
    return photos.where("camera <> ''").groupBy("folder").agg(F.count_distinct("camera").alias("cameras"), F.count(F.lit(1)).alias("photos")).where("cameras >= 2")


def half_away(value: Column, by: int) -> Column:
    """A quotient of whole numbers, halves away from zero."""
    return (F.signum(value) * F.floor((F.abs(value) + by // 2) / by)).cast("long")


def median_of(rows: DataFrame, by: list[str], value: str, as_: str) -> DataFrame:
    """Exact median of whole numbers by group: of an even number the lower middle plus half the step to the upper, cut.

    Equal values are counted first, so a group is as many rows as it has values.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("granary_n"))
    w = Window.partitionBy(*by)
    ranked = per.withColumn("granary_to", F.sum("granary_n").over(w.orderBy(value))).withColumn("granary_all", F.sum("granary_n").over(w))
    holds = lambda r: (F.col("granary_to") >= r) & (F.col("granary_to") - F.col("granary_n") < r)
    low, high = F.expr("(granary_all + 1) div 2"), F.expr("granary_all div 2 + 1")
    out = ranked.groupBy(*by).agg(F.max(F.when(holds(low), F.col(value))).alias("granary_a"), F.max(F.when(holds(high), F.col(value))).alias("granary_b"))
    return out.select(*by, (F.col("granary_a") + F.expr("(granary_b - granary_a) div 2")).alias(as_))


def own_gps(photos: DataFrame) -> DataFrame:
    """``folder``, ``camera`` and ``delta`` (seconds) of cameras whose own GPS times say how far they are off.

    Three photos with GPS or more, agreeing within ten minutes, beyond an hour
    where all their offsets are known, else beyond fourteen.
    """
    d = photos.where("gps_ns is not null and camera <> ''").withColumn("diff", F.col("capture_ns") - F.col("gps_ns"))
    by = ["folder", "camera"]
    per = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("diff").alias("low"), F.max("diff").alias("high"), F.bool_and("offset_known").alias("known"))
    limit = F.when(F.col("known"), 3600 * SECOND).otherwise(14 * 3600 * SECOND)
    at = per.join(median_of(d, by, "diff", "middle"), by)
    return at.where((F.col("n") >= 3) & (F.col("high") - F.col("low") <= 600 * SECOND) & (F.abs("middle") > limit)).select(*by, half_away(F.col("middle"), SECOND).alias("delta"))


_SHOT = ("folder", "camera", "capture_ns", "gps_ns", "offset_known", "folder_day")


def offset_candidates(photos: DataFrame) -> DataFrame:
    """Per event and camera how far its clock seems off: ``folder``, ``camera``, ``delta`` (seconds) and ``reference``.

    ``photos``: ``folder``, ``camera``, ``capture_ns``, ``gps_ns``, ``offset_known``
    and ``folder_day`` (a date struct or null).  By its own GPS; else where its
    photos span less than a day and lie wholly before or after the other
    cameras' range, widened by six hours: the difference of the medians.  What
    the other cameras' GPS or the folder's date says of them is the reference.
    """
    return _candidates(checkpoint(photos.where("camera <> ''").select(*_SHOT)))


def _candidates(shots: DataFrame) -> DataFrame:
    by = ["folder", "camera"]
    inside = F.coalesce(contains(F.col("folder_day"), F.col("capture_ns")), F.lit(False))
    gps_far = F.coalesce(F.abs(F.col("capture_ns") - F.col("gps_ns")) > 600 * SECOND, F.lit(False))
    per = shots.groupBy(*by).agg(
        F.min("capture_ns").alias("low"), F.max("capture_ns").alias("high"), F.count(F.lit(1)).alias("n"), F.count("gps_ns").alias("gps"), F.count_if(gps_far).alias("far"),
        F.count_if(inside).alias("inside"), F.max(F.col("folder_day").isNotNull()).alias("dated"),
    )
    # The other cameras' figures: the folder's less the camera's own; their ends by the first two of the folder's.
    w = Window.partitionBy("folder")
    second = lambda order: F.nth_value(order, 2).over(w.orderBy(*ends[order]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = lambda order: F.first(order).over(w.orderBy(*ends[order]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = {"low": [F.asc("low"), F.asc("camera")], "high": [F.desc("high"), F.asc("camera")]}
    turn = {x: F.row_number().over(w.orderBy(*ends[x])) for x in ends}
    figures = {f"other_{x}": F.when(turn[x] == 1, second(x)).otherwise(first(x)) for x in ends}
    figures |= {f"other_{x}": F.sum(x).over(w) - F.col(x) for x in ("n", "gps", "far", "inside")}
    at = per.withColumns({**figures, "has_day": F.max("dated").over(w)}).where("other_n > 0")
    at = checkpoint(at)
    margin = 6 * 3600 * SECOND
    apart = (F.col("high") - F.col("low") < DAY) & ((F.col("high") < F.col("other_low") - margin) | (F.col("low") > F.col("other_high") + margin))
    found = at.where(apart)
    # A camera that lies apart is the first or the last of its folder, so the others' median is two ranks of the folder's captures.
    asked = found.select("folder", F.col("camera").alias("of"), F.col("n").alias("own_n"), "other_n", (F.col("high") < F.col("other_low")).alias("before"))
    skip = F.when(F.col("before"), F.col("own_n")).otherwise(0)
    ranks = F.array(skip + F.expr("(other_n + 1) div 2"), skip + F.expr("other_n div 2 + 1"), F.when(F.col("before"), 0).otherwise(F.col("other_n")) + F.expr("(own_n + 1) div 2"), F.when(F.col("before"), 0).otherwise(F.col("other_n")) + F.expr("own_n div 2 + 1"))
    asked = asked.select("folder", "of", F.posexplode(ranks).alias("which", "place"))
    counted = shots.join(found.select("folder").distinct(), "folder", "left_semi").groupBy("folder", "capture_ns").agg(F.count(F.lit(1)).alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(w.orderBy("capture_ns")))
    picked = asked.join(upto, "folder").where("upto >= place and upto - k < place").groupBy("folder", "of").agg(*(F.max(F.when(F.col("which") == k, F.col("capture_ns"))).alias(f"v{k}") for k in range(4)))
    middles = picked.select("folder", F.col("of").alias("camera"), F.expr("v0 + (v1 - v0) div 2").alias("other_middle"), F.expr("v2 + (v3 - v2) div 2").alias("own_middle"))
    reference = (
        F.when((F.col("other_gps") > 0) & (F.col("other_far") == 0), "gps")
        .when(F.col("has_day") & (F.col("other_inside") == F.col("other_n")) & (F.col("inside") == 0), "folder_name").otherwise("none")
    )
    by_range = found.join(middles, by).select(*by, half_away(F.col("own_middle") - F.col("other_middle"), SECOND).alias("delta"), reference.alias("reference"))
    by_gps = own_gps(shots.join(at.select(*by), by, "left_semi")).withColumn("reference", F.lit("own_gps"))
    return by_gps.unionByName(by_range.join(by_gps.select(*by), by, "left_anti"))


def camera_shots(rows: DataFrame, now_ns: int) -> DataFrame:
    """What clocks are compared by (J13): photos with a camera and a plausible capture, moved by the owner's shift.

    ``rows``: photo_id, folder, camera, capture_ns, gps_ns, offset_known,
    folder_day, correction (null, set, shift, use_name, use_folder) and shift_s.  A
    photo that the owner dated otherwise says nothing about its camera.
    """
    usable = (F.col("camera") != "") & F.col("capture_ns").isNotNull() & plausible(instant(F.col("capture_ns")), now_ns)
    moved = F.col("capture_ns") + F.when(F.col("correction") == "shift", F.coalesce("shift_s", F.lit(0)) * SECOND).otherwise(0)
    return rows.where(usable & (F.col("correction").isNull() | (F.col("correction") == "shift"))).select("photo_id", *_SHOT[:2], moved.alias("capture_ns"), *_SHOT[3:])


def detection(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``detect`` and the events it rests on: ``camera``, ``folder``, ``delta``, ``reference`` of cameras that are off or disagree."""
    shots = checkpoint(photos.where("camera <> ''").select(*_SHOT))
    first = checkpoint(_candidates(shots))  # a row per event and camera at most
    backed = F.max(F.col("reference").isin("gps", "own_gps")) | ((F.count(F.lit(1)) >= 2) & F.max(F.col("reference") == "folder_name"))
    judged = first.groupBy("camera").agg((F.max("delta") - F.min("delta")).alias("spread"), backed.alias("backed"))
    agreed = judged.where("spread <= 600 and backed").join(median_of(first, ["camera"], "delta", "middle"), "camera")
    off = checkpoint(agreed.select("camera", (half_away(-F.col("middle"), 60) * 60).alias("shift_s")))
    second = first if off.isEmpty() else checkpoint(_candidates(shots.join(off, "camera", "left_anti")))
    again = second.select("camera").distinct().withColumn("again", F.lit(True))
    every = shots.groupBy("camera").agg(F.count(F.lit(1)).alias("photos"))
    cameras = every.join(off, "camera", "left").join(again, "camera", "left").select(
        "camera", "photos", F.when(F.col("shift_s").isNotNull(), "offset").when(F.col("again"), "disagrees").otherwise("ok").alias("state"), "shift_s"
    )
    columns = ["camera", "folder", "delta", "reference"]
    rest = second.join(off, "camera", "left_anti").select(*columns)
    return cameras, first.join(off, "camera", "left_semi").select(*columns).unionByName(rest)


def detect(photos: DataFrame) -> DataFrame:
    """``camera``, ``photos``, ``state`` (offset, disagrees, ok) and ``shift_s`` of every camera.

    Offset: all its candidates agree within ten minutes, and a GPS, or the
    folder's date at two events, sides with the others; the shift is minus the
    median, to the minute.  Then the rest is compared again without those
    cameras: who still has candidates disagrees.  The photos are written once,
    reduced to what both passes read.
    """
    return detection(photos)[0]


def camera_flags(flags: DataFrame, photos: DataFrame, cameras: DataFrame, events: DataFrame) -> DataFrame:
    """``flags`` (photo_id, flags) with CAMERA_OFFSET on the photos that an offset camera took at its events, and off on all others (M7)."""
    off = events.join(cameras.where("state = 'offset'").select("camera"), "camera", "left_semi").select("folder", "camera")
    marked = photos.join(off, ["folder", "camera"], "left_semi").select("photo_id", F.lit(CAMERA_OFFSET).alias("bit"))
    clear = F.col("flags").bitwiseAND(F.lit(~CAMERA_OFFSET))
    return flags.join(marked, "photo_id", "left").select("photo_id", clear.bitwiseOR(F.coalesce("bit", F.lit(0))).alias("flags"))


def cameras_read(cameras: DataFrame, events: DataFrame, photos: DataFrame) -> DataFrame:
    """Stored cameras and their events as they can still be shown (M19): without cameras and event folders that have no photos any more.

    One row per camera and event; a camera without events has one with nulls.
    """
    known = cameras.join(photos.select("camera").distinct(), "camera", "left_semi")
    left = events.join(photos.select("folder").distinct(), "folder", "left_semi")
    return known.join(left, "camera", "left")


def rederive(stored: DataFrame, rows: DataFrame, now_ns: int, this_year: int) -> DataFrame:
    """``stored`` dates brought up to date with their inputs (M17): ``photo_id``, ``inputs_key``, ``effective``, ``flags``.

    Only photos that are new or whose ``inputs_key`` differs are derived again; the
    others keep their row, and those without inputs lose theirs.  The camera bit
    is no input: a new derivation carries it over.
    """
    keyed = rows.withColumn("new_key", inputs_key(*(F.col(c) for c in ("path", "exif_ns", "gps_ns", "container_ns", "mtime_ns", "offset_known", "correction", "set_date", "shift_s"))))
    old = stored.select("photo_id", F.col("inputs_key").alias("old_key"), F.col("flags").bitwiseAND(F.lit(CAMERA_OFFSET)).alias("bit"))
    at = checkpoint(keyed.join(old, "photo_id", "left"))
    same = F.coalesce(F.col("old_key") == F.col("new_key"), F.lit(False))
    again = derive(at.where(~same), now_ns, this_year)
    derived = again.select("photo_id", F.col("new_key").alias("inputs_key"), "effective", F.col("flags").bitwiseOR(F.coalesce("bit", F.lit(0))).alias("flags"))
    kept = stored.join(at.where(same).select("photo_id"), "photo_id", "left_semi")
    return kept.select("photo_id", "inputs_key", "effective", "flags").unionByName(derived)
