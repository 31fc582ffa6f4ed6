"""Review lists and row figures: duplicates outside relations, covering folders, chains of folders, bands, plans.

Folders are named by ``source/path``.  Containment of one folder in another is
searched through each folder's rarest key only, so no key pairs all its holders
with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import FIRST_KNOWN_NS, depth, with_ancestors
from granary.operators import places, relations
from granary.operators.fold import first_by

FAMILIES = ("personal", "programs", "disposable", "containers")
YEAR_S = 365.25 * 24 * 3600
#: Upper bounds of the age bands in years and of the duplication bands.
AGES = ((1, "year1"), (3, "year3"), (5, "year5"), (10, "year10"))
SHARES = ((0.25, "under25"), (0.5, "under50"), (0.75, "under75"))


def representatives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of one folder of each set of equal ones, and ``folder``, ``rep`` of all."""
    of = relations.classes(files.where("key is not null"))
    return files.where("key is not null").join(of.where("folder = rep").select("folder"), "folder", "left_semi"), of


def holders(small: DataFrame, big: DataFrame) -> DataFrame:
    """Folders of ``big`` that hold every content of a folder of ``small``: ``a``, ``b``, ``matched`` and ``same``, where b is in a as well.

    Both have ``folder``, ``key``, ``size``, and are one table or share no
    folder.  The candidates are the holders of a's rarest key, which any folder
    that holds all of a has to hold.
    """
    held = big.select("folder", "key").distinct()
    n = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = small.join(n, "key", "left").groupBy("folder").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    pairs = rarest.select(F.col("folder").alias("a"), "key").join(held.select(F.col("folder").alias("b"), "key"), "key").where("a <> b").select("a", "b")
    both = big if small is big else small.select("folder", "key", "size").unionByName(big.select("folder", "key", "size"))
    found = relations.measured(pairs, both).where("matched_files = files").select("a", "b", "matched")
    back = relations.measured(found.select(F.col("b").alias("a"), F.col("a").alias("b")), both).where("matched_files = files")
    back = back.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("same"))
    return found.join(back, ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


def listed(files: DataFrame) -> DataFrame:
    """Relations that review lists show (``a``, ``b``, ``relation`` same or inside, ``matched``), between representatives of equal folders and their members."""
    return relations.labels(relations.class_matches(files)).where("relation in ('same', 'inside')")


def duplicate_groups(copy: DataFrame, sides: DataFrame) -> DataFrame:
    """Redundant bytes of each content that has a copy outside all listed relations.

    ``sides`` has the ``folder`` of each side of a listed relation.  Its rows
    count the copies inside and leave one of them standing, so copies outside
    are all redundant where some lie inside, and all but one elsewhere.
    """
    names = copy.select("digest", "size", "pkey", F.concat_ws("/", "source_id", "at_path").alias("path"))
    # Contents with a single physical copy are left before paths are spread.
    many = names.groupBy("digest").agg(F.count_distinct("pkey").alias("keys"), F.max("size").alias("size")).where("keys > 1")
    at = names.join(many.select("digest"), "digest", "left_semi")
    inside = with_ancestors(at).join(sides.select(F.col("folder").alias("ancestor")).distinct(), "ancestor", "left_semi")
    within = inside.groupBy("digest").agg(F.count_distinct("pkey").alias("within"))
    out = many.join(within, "digest", "left").withColumn("outside", F.col("keys") - F.coalesce("within", F.lit(0))).where("outside > 0")
    files = F.col("outside") - F.when(F.col("within").isNull(), 1).otherwise(0)
    return out.select("digest", files.alias("files"), (F.col("size") * files).alias("bytes"))


def covered_by(found: DataFrame) -> DataFrame:
    """The relation that covers each folder (W2, J11): most bytes matched, then the first; an inside covers its a side only."""
    arm = lambda own, other, kinds: found.where(F.col("relation").isin(*kinds)).select(F.col(own).alias("folder"), F.col(other).alias("other"), "relation", "matched", "a", "b")
    return first_by(arm("a", "b", ("same", "inside")).unionByName(arm("b", "a", ("same",))), ["folder"], F.desc("matched"), F.asc("a"), F.asc("b")).select("folder", "other", "relation", "matched")


def unpacked(archives: DataFrame, files: DataFrame) -> DataFrame:
    """Archives (``folder``: their name) all of whose members lie in one folder, once each (D14, D24): a same before an inside, then the first path."""
    (ours, of), (theirs, _) = representatives(archives), representatives(files)
    found = first_by(holders(ours, theirs), ["a"], F.desc("same"), F.asc("b"))
    return of.join(found.withColumnRenamed("a", "rep"), "rep").select(F.col("folder").alias("archive"), F.col("b").alias("folder"), "same")


def picked(files: DataFrame) -> DataFrame:
    """Of the folders that hold all of a folder, the one it is listed in (R10): a larger one before a twin, then the deepest, then the first path."""
    reps, of = representatives(files)
    place = F.struct((-depth(F.col("folder"))).alias("deep"), F.col("folder").alias("b"))
    first = of.groupBy("rep").agg(F.min(place).alias("first"))
    other = of.join(first, "rep").where("folder <> first.b").groupBy("rep").agg(F.min(place).alias("second"))
    outer = holders(reps, reps).join(first.withColumnRenamed("rep", "b"), "b")
    near = outer.groupBy(F.col("a").alias("rep")).agg(F.min(F.when(~F.col("same"), F.col("first"))).alias("larger"), F.min(F.when(F.col("same"), F.col("first"))).alias("alike"))
    at = of.join(first, "rep").join(other, "rep", "left").join(near, "rep", "left")
    twin = F.least(F.when(F.col("first.b") == F.col("folder"), F.col("second")).otherwise(F.col("first")), F.col("alike"))
    return at.select("folder", F.coalesce("larger", twin)["b"].alias("partner"), F.col("larger").isNull().alias("twin")).where("partner is not null")


def chains(entries: DataFrame) -> DataFrame:
    """Folders (``folder``) with the highest and the deepest one that hold just the same files: ``lifted``, ``lowered``.

    A folder has as many files as one below it only if it holds nothing else.
    """
    per = with_ancestors(entries).groupBy("ancestor", "level").agg(F.count(F.lit(1)).alias("files"))
    own = per.select(F.col("ancestor").alias("path"), "files", F.col("level").alias("own_level"))
    itself = own.select("path", "files", "own_level", F.col("path").alias("ancestor"))
    above = with_ancestors(own).select("path", "files", "own_level", "ancestor")
    up = itself.unionByName(above).join(per.select("ancestor", F.col("files").alias("above_files"), "level"), "ancestor").where("files = above_files")
    lifted = up.groupBy("path", "own_level").agg(F.min_by("ancestor", "level").alias("lifted"))
    low = lifted.groupBy("lifted").agg(F.max_by("path", "own_level").alias("lowered"))
    return lifted.join(low, "lifted").select(F.col("path").alias("folder"), "lifted", "lowered")


def families(rows: DataFrame, *by: str) -> DataFrame:
    """``composition`` by group (PJ3): family, bytes and files of those that are not nothing, in rank order."""
    rank = F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), F.col("family"))
    per = rows.groupBy(*by, "family").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
    one = F.struct(rank.alias("rank"), "family", "bytes", "files")
    return per.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("composition"))


def mixed_share(composition: Column, threshold: float = 0.01) -> Column:
    """``family`` and ``fraction`` of the main family where the others hold at least a hundredth of the bytes, else null (PJ18)."""
    total = F.aggregate(composition, F.lit(0).cast("long"), lambda s, c: s + c["bytes"])
    first = F.array_max(F.transform(composition, lambda c: F.struct(c["bytes"].alias("bytes"), (-c["rank"]).alias("rank"), c["family"].alias("family"))))
    mixed = (total > 0) & (total - first["bytes"] >= total * threshold)
    return F.when(mixed, F.struct(first["family"].alias("family"), (first["bytes"] / total).alias("fraction")))


def file_duplication(state: Column, copies: Column) -> Column:
    """``fraction`` and ``checked`` of a file (PJ16); null without content to compare."""
    known = ~state.isin("pending", "changed", "unreadable")
    fraction = F.when(known & (F.coalesce(copies, F.lit(1)) > 1), 1.0).otherwise(0.0)
    return F.when(state.isNotNull(), F.struct(fraction.alias("fraction"), known.alias("checked")))


def folder_duplication(rows: DataFrame, *by: str) -> DataFrame:
    """``fraction`` of the bytes that have another copy, and whether every candidate was read, by group (PJ16).

    ``rows`` are files below each folder with ``size``, ``content_state`` and ``copies``.
    """
    size = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0))
    state = F.col("content_state")
    return rows.groupBy(*by).agg(
        F.when(F.sum("size") > 0, size((state == "hashed") & (F.col("copies") > 1)) / F.sum("size")).otherwise(0.0).alias("fraction"),
        (size(state.isin("hashed", "sampled")) >= size(state.isNotNull() & (state != "unique_size"))).alias("checked"),
    )


def age_band(mtime_ns: Column, now_s: int) -> Column:
    """Band of the age in years of 365.25 days (PJ17); null for an unknown time."""
    years = (F.lit(float(now_s)) - mtime_ns / 1e9) / YEAR_S
    out = F.when(years < AGES[0][0], AGES[0][1])
    for bound, band in AGES[1:]:
        out = out.when(years < bound, band)
    return F.when(mtime_ns >= FIRST_KNOWN_NS, out.otherwise("older"))


def duplication_band(fraction: Column, checked: Column) -> Column:
    """Band of a duplicated fraction (PJ17); unchecked where something is left to read."""
    out = F.when(~checked, "unchecked").when(fraction <= 0, "none")
    for bound, band in SHARES:
        out = out.when(fraction < bound, band)
    return F.when(fraction.isNotNull(), out.otherwise("over75"))


def operation(kind: Column, op: Column) -> Column:
    """Label of a plan's step (PJ11): a rename is named by its plan, the rest by what is done."""
    named = places.mapped(kind, {"cleanup": "quarantine", "restore": "restore", "rename": "rename"})
    step = places.mapped(op, {"mkdir": "create_folder", "rmdir": "remove_folder", "record": "write_record", "unlink": "remove_record"})
    return F.when(op == "rename", F.coalesce(named, F.lit("move"))).otherwise(F.coalesce(step, op))


def archive_note(member: Column, name_extension: Column, state: Column, listed_too: Column, opened: tuple[str, ...], unsupported: tuple[str, ...]) -> Column:
    """Why an archive has no listing: nested, unsupported, not_listed; null for anything else (PJ14)."""
    can, cannot = name_extension.isin(*opened), name_extension.isin(*unsupported)
    note = F.when(member & (can | cannot), "nested").when(~member & cannot, "unsupported").when(~member & can & (state == "present"), "not_listed")
    return F.when(~F.coalesce(listed_too, F.lit(False)), note)


def media(files: DataFrame) -> DataFrame:
    """Present image and video files outside the quarantine."""
    return files.where("file_kind in ('image', 'video') and state = 'present' and not quarantined")


def expanded(files: DataFrame, entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Media files named by ``entries`` (``entry_id``) or below ``folders`` (``folder``: source/path), each once."""
    m = media(files)
    below = with_ancestors(m.select("entry_id", F.concat_ws("/", "source_id", "path").alias("path")))
    under = below.join(folders.select(F.col("folder").alias("ancestor")).distinct(), "ancestor", "left_semi").select("entry_id")
    return m.join(entries, "entry_id", "left_semi").select("entry_id").unionByName(under).distinct()


def rescue_plan(folders: DataFrame, own_keeps: DataFrame) -> DataFrame:
    """The outermost entries below each folder (``folder``) that are kept of their own (``path``): ``folder``, ``path``."""
    up = with_ancestors(own_keeps.select("path").distinct(), True)
    below = up.join(folders.select(F.col("folder").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("folder"), "path")
    kept = own_keeps.select(F.col("path").alias("ancestor")).distinct()
    nearest = up.join(kept, "ancestor", "left_semi").groupBy("path").agg(F.max("level").alias("kept_level"))
    # Another keep lies between a folder and the entry where the nearest one above the entry is deeper than the folder.
    return below.join(nearest, "path", "left").where("kept_level is null or kept_level <= " + "case when folder = '' then 0 else size(split(folder, '/', -1)) end").select("folder", "path")


def kept_within(entries: DataFrame) -> DataFrame:
    """``kept`` of every folder and entry: something at or below it is kept (X19); ``entries`` has ``path``, ``decision``."""
    mark = F.max(F.col("decision") == "keep")
    below = with_ancestors(entries).select(F.col("ancestor").alias("path"), "decision")
    return below.unionByName(entries.select("path", "decision")).groupBy("path").agg(F.coalesce(mark, F.lit(False)).alias("kept"))


def stale(items: DataFrame, changed: DataFrame) -> DataFrame:
    """Checks (``check_id``) with an item or a copy (``path``) at or below a changed ``path``."""
    at = items.select("check_id", F.col("path").alias("ancestor")).unionByName(with_ancestors(items.select("check_id", "path")).select("check_id", "ancestor"))
    return at.join(changed.select(F.col("path").alias("ancestor")).distinct(), "ancestor", "left_semi").select("check_id").distinct()


def freed(deleted: DataFrame, *by: str) -> DataFrame:
    """``files``, ``bytes`` and ``freed`` of deleted names (A31): a hard-linked file is freed once, with the last of its ``nlink`` names."""
    per = deleted.withColumn("pkey", places.physical_key()).groupBy(*by, "pkey").agg(
        F.count(F.lit(1)).alias("names"), F.sum("size").alias("all"), F.max("size").alias("one"), F.max(F.when(F.substring("pkey", 1, 1) == "h", F.col("nlink")).otherwise(1)).alias("links")
    )
    return per.groupBy(*by).agg(F.sum("names").alias("files"), F.sum("all").alias("bytes"), F.sum(F.when(F.col("names") >= F.col("links"), F.col("one")).otherwise(0)).alias("freed"))


def to_read(files: DataFrame) -> DataFrame:
    """Files and bytes that a check of each folder reads: present and not empty."""
    rows = files.where("state = 'present' and size > 0").select("source_id", "path", "size")
    return with_ancestors(rows, True).groupBy("source_id", "ancestor").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def member_folders(members: DataFrame) -> DataFrame:
    """Files, bytes and copied files below each folder of an archive, its top included (D20); ``members`` has ``copied``."""
    return with_ancestors(members, True).groupBy("archive_id", "ancestor").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("copied").alias("copied")
    )


def newest_plan_first(items: DataFrame, *by: str) -> DataFrame:
    """``rank`` of quarantined items (O13): plan and sequence names read as numbers, the largest first, then the entry."""
    number = lambda c: F.coalesce(F.expr(f"try_cast(regexp_extract({c}, '^[0-9]+', 0) as long)"), F.lit(0))
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(number("plan").desc(), number("seq").desc(), F.desc("entry_id"))))


#: The list that a category is on; and all lists, in the order that decides among equals.
LIST_OF = {
    "system_junk": "system_junk", "installer_download": "installers", "application_installation": "programs", "os_installation": "programs",
    "cache": "caches", "temporary_data": "caches", "generated_artifacts": "caches",
}
LISTS = ("rescue", "duplicates", "unpacked_archives", "system_junk", "installers", "programs", "caches", "leftovers")


def rule_lists(entries: DataFrame) -> DataFrame:
    """Rows of the lists that rules fill (D12): ``entry_id``, ``source_id``, ``path``, ``list``, ``bytes``.

    ``entries``: entry_id, source_id, path, kind (file, directory), state,
    quarantined, category, bytes, files, partial_download and complete (a folder
    in which all could be seen).  An entry is on its category's list; a partial
    download among the caches is a leftover, and so are empty files and complete
    folders without files.  On a list only the topmost of nested entries stands.
    """
    own = places.mapped(F.col("category"), LIST_OF)
    partial = F.coalesce("partial_download", F.lit(False))
    by_rule = F.when(partial & (own == "caches"), "leftovers").otherwise(own)
    empty = ((F.col("kind") == "file") & (F.col("bytes") == 0)) | ((F.col("kind") == "directory") & (F.col("files") == 0) & (F.col("state") == "present") & F.col("complete"))
    left = F.when(empty & ~F.coalesce(partial & (own == "caches"), F.lit(False)), "leftovers")
    named = F.array_distinct(F.filter(F.array(by_rule, left), lambda x: x.isNotNull()))
    rows = entries.where((F.col("state") != "missing") & ~F.col("quarantined") & (F.col("path") != "")).select("entry_id", "source_id", "path", "bytes", F.explode(named).alias("list"))
    key = ["list", "source_id", "path"]
    under = with_ancestors(rows).join(rows.select("list", "source_id", F.col("path").alias("ancestor")), ["list", "source_id", "ancestor"], "left_semi")
    return rows.join(under.select(*key).distinct(), key, "left_anti")


def cards(rows: DataFrame) -> DataFrame:
    """A card per list (A18): open and decided ``rows`` and ``bytes``, lists without rows too, and their ``place``.

    ``rows``: list, bytes and is_open; a null is_open counts as neither.  Rescue
    comes first while it has open rows, then more open bytes, then LISTS' order.
    """
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    open_, decided = F.col("is_open"), ~F.col("is_open")
    per = rows.groupBy("list").agg(F.count_if(open_).alias("open_rows"), amount(open_).alias("open_bytes"), F.count_if(decided).alias("decided_rows"), amount(decided).alias("decided_bytes"))
    every = rows.sparkSession.createDataFrame(list(enumerate(LISTS)), "rank int, list string")
    figures = ["open_rows", "open_bytes", "decided_rows", "decided_bytes"]
    full = every.join(per, "list", "left").select("rank", "list", *(F.coalesce(c, F.lit(0)).alias(c) for c in figures))
    order = Window.orderBy(((F.col("list") == "rescue") & (F.col("open_rows") > 0)).desc(), F.desc("open_bytes"), "rank")  # as many rows as lists
    return full.withColumn("place", F.row_number().over(order)).drop("rank")


def page(rows: DataFrame, name: str, decided: bool, most: int = 50, after: tuple[int, int] | None = None) -> DataFrame:
    """A list's first rows (O8), open or decided: more bytes first, then the larger id; ``after`` is the (bytes, id) of the last row seen.

    One row more than ``most`` tells that there is a next page.
    """
    found = rows.where((F.col("list") == name) & (F.col("is_open") == (not decided)))
    if after is not None:
        size, entry = after
        found = found.where((F.col("bytes") < size) | ((F.col("bytes") == size) & (F.col("entry_id") < entry)))
    return found.orderBy(F.desc("bytes"), F.desc("entry_id")).limit(most + 1)
