"""Where the copies of a content are: files and archive members alike.

A copy is a present file outside the quarantine, or a file member of a complete
archive whose own file is one.  The names of one inode on a source with stable
identities are one copy; so are a tar hard link and its target, and a member seen
through two names of one archive.  Every question about other copies is answered
by figures per content, aggregated once; copies are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import with_ancestors
from granary.functions.runs import checkpoint

#: In the order in which they decide a folder's place.
ORDER = ("only_copy", "this_source", "unchecked", "unreadable", "other_source")
#: Smallest size whose content is sampled before it is read.
SAMPLE_FROM = 16 << 20

FAMILY_OF = {
    "personal_media": "personal", "documents": "personal", "source_project": "personal", "application_user_data": "personal",
    "application_installation": "programs", "application_configuration": "programs", "os_installation": "programs", "installer_download": "programs",
    "system_junk": "disposable", "cache": "disposable", "temporary_data": "disposable", "generated_artifacts": "disposable",
    "download_collection": "containers", "backup": "containers", "mixed": "containers", "unknown": "containers",
}
KIND_FAMILY = {
    "image": "personal", "video": "personal", "audio": "personal", "document": "personal", "source": "personal",
    "installer": "programs", "executable": "programs", "system": "disposable",
}


def mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def file_family(category: Column, kind: Column) -> Column:
    """The category's family, or, where that is unknown or absent, the kind's; containers for the rest."""
    own = F.when(category != "unknown", mapped(category, FAMILY_OF))
    return F.coalesce(own, mapped(kind, KIND_FAMILY), F.lit("containers"))


def disposable(category: Column, kind: Column, triage: Column) -> Column:
    """Family disposable and not up for review; missing values are no value (F16)."""
    return (file_family(category, kind) == "disposable") & (F.coalesce(triage, F.lit("")) != "review")


def physical_key() -> Column:
    linked = (F.col("nlink") > 1) & F.col("ino").isNotNull() & F.col("dev").isNotNull() & F.col("stable")
    return F.when(linked, F.concat(F.lit("h"), "source_id", F.lit("/"), "dev", F.lit("/"), "ino")).otherwise(F.concat(F.lit("e"), "entry_id"))


#: A chain of links is followed over 2 to the power of this many hops.
LINK_DOUBLINGS = 6


def resolve_links(members: DataFrame) -> DataFrame:
    """A tar hard link takes size, state and content of the file at the end of its chain of links.

    ``link_path`` names the next member in the same archive.  Pointers are
    doubled, so a chain of 64 links takes six joins of the links alone; a chain
    that is longer, runs in a circle or ends at nothing has no known content and
    keeps its own size.
    """
    links = members.where("link_path is not null").select("archive_id", F.col("path").alias("start"), F.col("link_path").alias("at"))
    for _ in range(LINK_DOUBLINGS):
        following = links.select("archive_id", F.col("start").alias("at"), F.col("at").alias("next"))
        moved = links.join(following, ["archive_id", "at"], "left").select("archive_id", "start", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("on"))
        if moved.where("on").isEmpty():
            break
        links = checkpoint(moved.drop("on"))
    target = members.where("link_path is null").select(
        "archive_id", F.col("path").alias("at"), F.col("raw_size").alias("t_size"), F.col("raw_state").alias("t_state"), F.col("raw_digest").alias("t_digest")
    )
    ends = links.join(target, ["archive_id", "at"]).select(F.col("archive_id").alias("of"), "start", "t_size", "t_state", "t_digest")
    link = F.col("link_path").isNotNull()
    return members.join(ends, link & (F.col("archive_id") == F.col("of")) & (F.col("path") == F.col("start")), "left").select(
        "member_id", "archive_id", "path", "link_path",
        F.coalesce("t_size", "raw_size").alias("size"),
        F.when(link, F.col("t_state")).otherwise(F.col("raw_state")).alias("content_state"),
        F.when(link, F.col("t_digest")).otherwise(F.col("raw_digest")).alias("digest"),
    )


def split_archive(size: Column, weights: Column) -> Column:
    """Shares of an archive's ``size`` by the bytes of its members in each place, in the order of ``ORDER``.

    Exact quotients in decimals, the rest to the largest remainders (ties to the
    earlier place); then every place with members but no share takes one byte
    from the largest share while that has more than one.  Without members all
    are nothing; a negative size counts as none.
    """
    whole = lambda c: c.cast("decimal(20,0)")
    most = F.greatest(size, F.lit(0).cast("long"))
    w = F.transform(weights, lambda x: F.greatest(x, F.lit(0).cast("long")))
    total = F.aggregate(w, F.lit(0).cast("decimal(20,0)"), lambda s, x: whole(s + x))
    product = lambda x: (most.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)")
    parts = F.transform(w, lambda x: F.struct(F.call_function("div", product(x), total).alias("share"), F.call_function("mod", product(x), total.cast("decimal(38,0)")).alias("rest")))
    left = most - F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + p["share"])

    def first_of_rest(p: Column, k: Column) -> Column:
        before = F.filter(F.transform(parts, lambda q, j: (q["rest"] > p["rest"]) | ((q["rest"] == p["rest"]) & (j < k) & (F.element_at(w, j + 1) > 0))), lambda x: x)
        return (F.element_at(w, k + 1) > 0) & (F.size(before) < left)

    shares = F.transform(parts, lambda p, k: p["share"] + F.when(first_of_rest(p, k), 1).otherwise(0))

    def one_byte(acc: Column, k: Column) -> Column:
        top = F.array_max(acc)
        move = (F.element_at(w, k + 1) > 0) & (F.element_at(acc, k + 1) == 0) & (top > 1)
        moved = F.transform(acc, lambda x, j: x + F.when(j == k, 1).otherwise(0) - F.when(j + 1 == F.array_position(acc, top), 1).otherwise(0))
        return F.when(move, moved).otherwise(acc)

    fair = F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), shares.cast("array<bigint>"), one_byte)
    return F.when(total > 0, fair).otherwise(F.transform(w, lambda x: F.lit(0).cast("long")))


def split_sql(table: str) -> str:
    """CTEs up to ``split`` (the table's columns and ``shares``): ``split_archive`` over ``size`` and ``w``, five weights (HUGEINT)."""
    steps = [
        f"""quotients AS (SELECT *, list_sum(w) AS total, [CASE WHEN list_sum(w) > 0 THEN greatest(size, 0)::HUGEINT * x // list_sum(w) ELSE 0 END FOR x IN w] AS q,
          [CASE WHEN list_sum(w) > 0 THEN greatest(size, 0)::HUGEINT * x % list_sum(w)::HUGEINT ELSE 0 END FOR x IN w] AS r FROM {table})""",
        "ordered AS (SELECT *, greatest(size, 0) - list_sum(q) AS spare, [w[k] > 0 AND len([j FOR j IN range(1, 6) IF r[j] > r[k] OR (r[j] = r[k] AND j < k AND w[j] > 0)]) < greatest(size, 0) - list_sum(q) FOR k IN range(1, 6)] AS lucky FROM quotients)",
        "s0 AS (SELECT *, [q[k] + CASE WHEN total > 0 AND lucky[k] THEN 1 ELSE 0 END FOR k IN range(1, 6)] AS s FROM ordered)",
    ]
    for k in range(1, 6):
        steps.append(f"s{k} AS (SELECT * REPLACE (CASE WHEN w[{k}] > 0 AND s[{k}] = 0 AND list_max(s) > 1 THEN [s[j] + CASE WHEN j = {k} THEN 1 ELSE 0 END - CASE WHEN j = list_position(s, list_max(s)) THEN 1 ELSE 0 END FOR j IN range(1, 6)] ELSE s END AS s) FROM s{k - 1})")
    return ", ".join([*steps, "split AS (SELECT *, s::BIGINT[] AS shares FROM s5)"])


def placed_members(members: DataFrame, archives: DataFrame, files: DataFrame) -> DataFrame:
    """Members with what they take from their archive's file: source, state, keys."""
    at = files.withColumn("akey", physical_key()).select(
        F.col("entry_id").alias("holder"), "source_id", "online", "state", "quarantined", F.col("path").alias("at_path"), "akey"
    )
    return members.join(archives, "archive_id").join(at, F.col("archive_id") == F.col("holder")).withColumn(
        "pkey", F.concat(F.lit("m"), "akey", F.lit("/"), F.coalesce("link_path", "path"))
    )


def copies(files: DataFrame, members: DataFrame) -> DataFrame:
    """One row per name of a copy: ``digest``, ``size``, ``member``, ``id``, ``holder``, ``source_id``, ``online``, ``at_path``, ``pkey``.

    ``members`` as of ``placed_members``.
    """
    live = (F.col("state") == "present") & ~F.col("quarantined") & (F.col("content_state") == "hashed")
    columns = ["digest", "size", "member", "id", "holder", "source_id", "online", "at_path", "pkey"]
    own = files.where(live).withColumns({"pkey": physical_key(), "member": F.lit(False), "id": F.col("entry_id"), "holder": F.col("entry_id"), "at_path": F.col("path")})
    inner = members.where(live & (F.col("listing") == "complete")).withColumns({"member": F.lit(True), "id": F.col("member_id")})
    return own.select(*columns).unionByName(inner.select(*columns))


def contents(copy: DataFrame) -> DataFrame:
    """Per content: ``n_names``, ``n_copies``, ``n_sources``, ``n_online`` (sources) and ``any_member``."""
    return copy.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count_distinct("pkey").alias("n_copies"),
        F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct(F.when(F.col("online"), F.col("source_id"))).alias("n_online"),
        F.bool_or("member").alias("any_member"),
    )


def by_state(state: Column) -> Column:
    """Place of a present, non-empty file by its content state and its content's figures."""
    return (
        F.when(state.isNull() | state.isin("pending", "changed"), "unchecked")
        .when(state.isin("unique_size", "sampled"), "only_copy")
        .when(state == "unreadable", "unreadable")
        .when(F.col("n_sources") > 1, "other_source")
        .when(F.col("n_copies") > 1, "this_source")
        .otherwise("only_copy")
    )


def _place() -> Column:
    return F.when((F.col("state") != "present") | F.col("quarantined"), None).when(F.col("size") <= 0, "none").otherwise(by_state(F.col("content_state")))


def places(rows: DataFrame, copy: DataFrame) -> DataFrame:
    """Adds the content's figures, ``place`` (null for what is missing or quarantined) and ``offline_only``.

    ``rows`` are files or placed members.  Offline-only: a copy on another
    source, and none of those sources is online.
    """
    other_online = F.col("n_online") - F.when(F.col("online"), 1).otherwise(0)
    live = (F.col("state") == "present") & ~F.col("quarantined") & (F.col("content_state") == "hashed")
    return (
        rows.join(contents(copy), "digest", "left")
        .withColumn("place", _place())
        .withColumn("offline_only", F.coalesce(live & (F.col("n_sources") > 1) & (other_online == 0), F.lit(False)))
    )


def shown_copies() -> Column:
    """The copies column of a file (PJ2): null where missing or quarantined or not known, 1 where size or sample is unique."""
    return (
        F.when((F.col("state") != "present") | F.col("quarantined"), None)
        .when(F.col("content_state") == "hashed", F.coalesce("n_copies", F.lit(0)))
        .when(F.col("content_state").isin("unique_size", "sampled"), 1)
    )


def duplicate_class(inside: Column | None = None) -> Column:
    """Names of the duplicate filters that a present file matches (F10); ``inside`` is how many copies of its content lie in the searched range."""
    hashed = F.col("content_state") == "hashed"
    another = hashed & (F.col("n_copies") > 1)
    tests = {
        "copies": another,
        "unique": F.col("content_state").isin("unique_size", "sampled") | (hashed & ~another),
        "unchecked": F.col("content_state").isin("pending", "changed", "unreadable"),
    }
    if inside is not None:
        tests["elsewhere"] = hashed & (F.col("n_copies") > inside)
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def sums(rows: DataFrame, *by: str) -> DataFrame:
    """Files and bytes of each place and of disposable files, by group; what has no place or is empty counts nowhere.

    A column ``n``, where there is one, says for how many files a row counts.
    """
    counted = rows.where(F.col("place").isin(*ORDER))
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    out = []
    for p in (*ORDER, "disposable"):
        here = F.col("disposable") if p == "disposable" else (F.col("place") == p) & ~F.col("disposable")
        amount = lambda c: F.sum(F.when(here, c).otherwise(0)).cast("long")  # noqa: B023, E731
        out += [amount(n).alias(f"{p}_files"), amount(F.col("size")).alias(f"{p}_bytes")]
    return counted.groupBy(*by).agg(*out)


def with_archives_split(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """``rows`` of files with complete archives dealt over the places of their members (A20), for ``sums``.

    ``covers`` is ``cover`` of the archives.  An archive that is not disposable
    gives each place its share of the archive's own size and is one file in the
    first place that its members are in; with no bytes in its members it counts
    nowhere.
    """
    weights = covers.select(F.col("archive_id").alias("entry_id"), F.array(*(F.col(f"{p}_bytes") for p in ORDER)).alias("weights"))
    at = rows.join(weights, "entry_id", "left")
    shares = split_archive(F.col("size"), F.col("weights"))
    some = F.transform("weights", lambda w: w > 0)
    first = F.array_position(some, F.lit(True))
    names = F.array(*(F.lit(p) for p in ORDER))
    part = lambda place, size, n: F.struct(place.alias("place"), size.cast("long").alias("size"), n.cast("int").alias("n"))
    dealt = F.transform(shares, lambda x, k: part(F.element_at(names, k + 1), x, F.when(k + 1 == first, 1).otherwise(0)))
    dealt = F.filter(F.zip_with(dealt, some, lambda d, y: F.when(y, d)), lambda d: d.isNotNull())
    split = F.col("weights").isNotNull() & ~F.col("disposable") & F.col("place").isin(*ORDER)
    parts = F.when(split, dealt).otherwise(F.array(part(F.col("place"), F.col("size"), F.lit(1))))
    rest = [c for c in rows.columns if c not in ("place", "size", "n")]
    return at.select(*rest, F.explode(parts).alias("part")).select(*rest, "part.place", "part.size", "part.n")


def folder_place(complete: Column) -> Column:
    """The first place in ORDER with a file; other_source and none become unreadable below an incomplete folder."""
    out = F.when(F.col(f"{ORDER[0]}_files") > 0, ORDER[0])
    for p in ORDER[1:]:
        out = out.when(F.col(f"{p}_files") > 0, p)
    found = out.otherwise("none")
    return F.when(~complete & found.isin("other_source", "none"), "unreadable").otherwise(found)


def only_here(place: Column, size: Column, is_disposable: Column) -> Column:
    """Sort key of a file: bytes that are only on this source, then bytes not checked or unreadable."""
    here = F.when(is_disposable | place.isNull(), 0).when(place.isin("only_copy", "this_source"), size).otherwise(0)
    open_ = F.when(is_disposable | place.isNull(), 0).when(place.isin("unchecked", "unreadable"), size).otherwise(0)
    return F.struct(here.alias("here"), open_.alias("open"))


def cover(member_sums: DataFrame, own: DataFrame) -> DataFrame:
    """Member sums of complete archives under their own file's place.

    ``own`` has ``archive_id`` and ``own_place``.  An archive that lies on
    another source covers all its members; one with a copy on this source makes
    its only copies this_source.
    """
    at = member_sums.join(own, "archive_id")
    out = {}
    for x in ("files", "bytes"):
        whole = sum((F.col(f"{p}_{x}") for p in ORDER[1:]), F.col(f"{ORDER[0]}_{x}"))
        for p in ORDER:
            mine = F.col(f"{p}_{x}")
            away = whole if p == "other_source" else F.lit(0)
            here = mine + F.col(f"only_copy_{x}") if p == "this_source" else F.lit(0) if p == "only_copy" else mine
            out[f"{p}_{x}"] = F.when(F.col("own_place") == "other_source", away).when(F.col("own_place") == "this_source", here).otherwise(mine).cast("long")
    return at.select("archive_id", *(e.alias(c) for c, e in out.items()), "disposable_files", "disposable_bytes")


def size_states(files: DataFrame, members: DataFrame) -> DataFrame:
    """Next content state of every counted file of a size.

    A size with one physical copy is unique; hashed files keep their state, and
    so do changed and unreadable ones of a shared size.  Of the others a large
    file whose sample differs from every other copy's is sampled, else pending;
    a member or a copy without a sample may be equal to it.
    """
    live = (F.col("state") == "present") & ~F.col("quarantined")
    f = files.where(live & F.col("content_state").isNotNull()).withColumns({"pkey": physical_key(), "sample_key": F.col("sample"), "member": F.lit(False)})
    m = members.where(live & (F.col("listing") == "complete") & F.col("content_state").isNotNull()).withColumns({"sample_key": F.lit(None).cast("string"), "member": F.lit(True)})
    every = f.select("size", "pkey", "sample_key", "member").unionByName(m.select("size", "pkey", "sample_key", "member"))
    # Per size: copies, and copies that no sample tells apart; per size and sample: copies.
    of_size = every.groupBy("size").agg(F.count_distinct("pkey").alias("copies"), F.count_distinct(F.when(F.col("sample_key").isNull(), F.col("pkey"))).alias("untold"))
    of_sample = every.where("sample_key is not null").groupBy("size", "sample_key").agg(F.count_distinct("pkey").alias("same_sample"))
    alone = F.coalesce((F.col("size") >= SAMPLE_FROM) & F.col("sample_key").isNotNull() & (F.col("untold") == 0) & (F.col("same_sample") == 1), F.lit(False))
    return (
        f.join(of_size, "size")
        .join(of_sample, ["size", "sample_key"], "left")
        .withColumn(
            "next_state",
            F.when(F.col("content_state") == "hashed", "hashed")
            .when(F.col("copies") < 2, "unique_size")
            .when(F.col("content_state").isin("unique_size", "pending", "sampled"), F.when(alone, "sampled").otherwise("pending"))
            .otherwise(F.col("content_state")),
        )
    )


def coverage(rows: DataFrame, *by: str) -> DataFrame:
    """Files and bytes that are candidates, checked, unchecked and unreadable."""
    state, buckets = F.col("content_state"), {}
    buckets["candidate"] = state != "unique_size"
    buckets["checked"] = state.isin("hashed", "sampled")
    buckets["unchecked"] = state.isin("pending", "changed")
    buckets["unreadable"] = state == "unreadable"
    figures = []
    for name, test in buckets.items():
        figures += [F.count_if(test).alias(f"{name}_files"), F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).alias(f"{name}_bytes")]
    return rows.groupBy(*by).agg(*figures)


def blind(rows: DataFrame, partial: DataFrame) -> DataFrame:
    """Folders of files (``source_id``, ``ancestor``) and whether something in or below them could not be seen.

    That is an unreadable file, or a folder (``partial``: source_id, path) that was
    not readable, was read in part or begins another volume.  Its mark rises to
    every folder above it.
    """
    key = ["source_id", "ancestor"]
    shut = with_ancestors(rows, True).groupBy(*key).agg(F.bool_or(F.col("state") == "unreadable").alias("shut"))
    above = with_ancestors(partial, True).select(*key).unionByName(partial.select("source_id", F.col("path").alias("ancestor")))
    return shut.join(above.distinct().withColumn("gap", F.lit(True)), key, "left").select(*key, (F.col("shut") | F.coalesce("gap", F.lit(False))).alias("blind"))


def folder_duplication(files: DataFrame, copy: DataFrame) -> DataFrame:
    """Per ``source_id`` and folder (``ancestor``) the bytes that are candidates, checked, duplicated and unreadable."""
    n = copy.groupBy("digest").agg(F.count_distinct("pkey").alias("copies"))
    live = files.where("state = 'present' and not quarantined and size > 0 and content_state is not null").join(n, "digest", "left")
    state = F.col("content_state")
    amount = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    return with_ancestors(live, True).groupBy("source_id", "ancestor").agg(
        amount(~state.isin("unique_size", "unreadable")).alias("candidate"),
        amount(state.isin("hashed", "sampled")).alias("checked"),
        amount((state == "hashed") & F.coalesce(F.col("copies") > 1, F.lit(False))).alias("duplicated"),
        amount(state == "unreadable").alias("unreadable"),
    )


def preferred(wants: DataFrame, copy: DataFrame) -> DataFrame:
    """For each want (``member``, ``id``, ``digest``, ``source_id``, ``pkey``, ``place``) the copy to show.

    Where the place is other_source: of the copies on other sources the first by
    (source offline, member, id).  Where it is this_source: of the other physical
    copies here the first by (member, id).  Two candidates per content, and per
    content and source, hold the answer for every want, so nothing is paired.
    """
    rank = F.struct((~F.col("online")).alias("offline"), "member", "id", "source_id", "pkey")
    per_source = copy.groupBy("digest", "source_id").agg(F.min(rank).alias("r"))
    per_key = copy.groupBy("digest", "source_id", "pkey").agg(F.min(F.struct("member", "id", "pkey")).alias("r"))

    def two(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        at = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("r"))).where("n <= 2")
        return at.groupBy(*by).agg(F.min("r").alias(f"{name}1"), F.max(F.when(F.col("n") == 2, F.col("r"))).alias(f"{name}2"))

    away, here = two(per_source, ["digest"], "away"), two(per_key, ["digest", "source_id"], "here")
    found = wants.join(away, "digest").join(here, ["digest", "source_id"], "left")
    other = F.when(F.col("away1.source_id") != F.col("source_id"), F.col("away1")).otherwise(F.col("away2"))
    near = F.when(F.col("here1.pkey") != F.col("pkey"), F.col("here1")).otherwise(F.col("here2"))
    return found.select(
        "member", "id", "place",
        F.when(F.col("place") == "other_source", other["member"]).otherwise(near["member"]).alias("copy_member"),
        F.when(F.col("place") == "other_source", other["id"]).otherwise(near["id"]).alias("copy_id"),
        F.when(F.col("place") == "other_source", other["source_id"]).otherwise(F.col("source_id")).alias("copy_source"),
        F.when(F.col("place") == "other_source", other["offline"]).otherwise(~F.col("online")).alias("copy_offline"),
    ).where("copy_id is not null")


MAIL = ("eml", "mbox", "msg", "pst", "dbx")
VALUABLE_TRAITS = ("contains_user_material", "contains_credentials", "contains_database")


def purge_class(category: Column, kind: Column, traits: Column, extension: Column) -> Column:
    """How a file without another copy ranks when it is about to be deleted."""
    family, of_category = file_family(category, kind), mapped(category, FAMILY_OF)
    valuable = (
        (F.coalesce(family, F.lit("")) == "personal") | (F.coalesce(of_category, F.lit("")) == "personal") | F.coalesce(extension, F.lit("")).isin(*MAIL)
        | F.coalesce(F.arrays_overlap(traits, F.array(*(F.lit(t) for t in VALUABLE_TRAITS))), F.lit(False))
        | F.coalesce(kind, F.lit("")).isin("image", "video", "audio", "document", "source")
    )
    junk = (family == "disposable") | (F.coalesce(of_category, F.lit("")) == "disposable") | F.coalesce(category, F.lit("")).isin("installer_download", "application_installation", "os_installation")
    return F.when(valuable, "possibly_valuable").when(junk, "likely_junk").otherwise("uncertain")


def verdict(item_readable: Column, other_online: Column, other_offline: Column, listing: Column) -> Column:
    """What deleting a present or unreadable entry would lose (X12), by its copies outside what is deleted.

    ``listing`` is the state of an archive's listing, null where there is none.
    """
    opaque = listing.isNotNull() | (F.col("file_kind") == "archive")
    return (
        F.when(F.col("state") == "missing", None)
        .when(~item_readable, "unreadable")
        .when(F.col("state") == "unreadable", "unreadable")
        .when(F.col("size") == 0, "no_content")
        .when(F.coalesce(listing == "complete", F.lit(False)), "no_content")
        .when(other_online, F.when(opaque, "opaque_archive").otherwise("safe"))
        .when(other_offline, "copy_offline")
        .when(opaque, "opaque_archive")
        .otherwise("unique")
    )
