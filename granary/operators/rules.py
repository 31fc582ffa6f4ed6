"""Names to signals and kinds, facts to categories: a rule pack of literals.

A pack is data (``load_pack`` reads one from TOML); its rules become a projection
over an entry's facts, so classification neither joins nor shuffles.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.paths import extension, glob_pattern, name, parent, with_ancestors
from granary.operators.places import FAMILY_OF, mapped

TRAITS = ("contains_user_material", "contains_credentials", "contains_database", "contains_vcs", "possible_generated_content")
TRIAGE_OF = {
    "personal_media": "keep", "documents": "keep", "source_project": "keep", "application_user_data": "keep",
    "system_junk": "discard", "cache": "discard", "temporary_data": "discard", "generated_artifacts": "discard",
    "installer_download": "discard", "application_installation": "discard",
}
GROUPED = ("application_installation", "os_installation", "source_project", "application_user_data", "cache", "generated_artifacts", "backup")


@dataclass(frozen=True)
class Share:
    """At least so many files, and so large a share of the bytes, of these kinds; without bytes only a zero share holds (C11)."""

    kinds: tuple[str, ...]
    min_files: int = 1
    min_bytes: float = 0.0

    def holds(self, files: Column, in_kinds: Column, whole: Column) -> Column:
        return (files >= self.min_files) & F.when(whole == 0, F.lit(self.min_bytes == 0)).otherwise(in_kinds.cast("double") >= self.min_bytes * whole.cast("double"))


@dataclass(frozen=True)
class Signal:
    id: str
    names: tuple[str, ...]
    except_: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    indicator: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    category: str = ""
    names: tuple[str, ...] = ()
    traits: tuple[str, ...] = ()
    review: bool = False
    share: Share | None = None
    child_all: tuple[str, ...] = ()
    child_any: tuple[str, ...] = ()
    child_none: tuple[str, ...] = ()
    subtree: dict[str, int] = field(default_factory=dict)
    explain: str = ""


@dataclass(frozen=True)
class Pack:
    signals: tuple[Signal, ...]
    files: tuple[Rule, ...]
    folders: tuple[Rule, ...]
    kind_names: tuple[tuple[str, tuple[str, ...]], ...] = ()
    kind_of: dict[str, str] = field(default_factory=dict)
    pairs: tuple[tuple[str, str, str], ...] = ()


def load_pack(text: str) -> Pack:
    """A pack from TOML tables ``signal``, ``file``, ``folder``, ``kinds``; unknown signals, traits or categories and repeated ids are refused."""
    raw = tomllib.loads(text)
    listed = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}

    def rule(d: dict) -> Rule:
        d = listed(d)
        if "share" in d:
            d["share"] = Share(**listed(d["share"]))
        return Rule(**d)

    pack = Pack(
        tuple(Signal(**{("except_" if k == "except" else k): v for k, v in listed(d).items()}) for d in raw.get("signal", [])),
        tuple(map(rule, raw.get("file", []))),
        tuple(map(rule, raw.get("folder", []))),
        kind_of=raw.get("kinds", {}),
    )
    known, ids = {s.id for s in pack.signals}, set()
    for r in (*pack.files, *pack.folders):
        if r.id in ids:
            raise ValueError(f"rule {r.id!r} is there twice")
        ids.add(r.id)
        if missing := {*r.child_all, *r.child_any, *r.child_none, *r.subtree} - known:
            raise ValueError(f"rule {r.id!r} names unknown signals {sorted(missing)}")
        if r.category and r.category not in FAMILY_OF:
            raise ValueError(f"rule {r.id!r} names the unknown category {r.category!r}")
        if missing := set(r.traits) - set(TRAITS):
            raise ValueError(f"rule {r.id!r} names unknown traits {sorted(missing)}")
    return pack


def any_name(column: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | column.rlike(glob_pattern(g))
    return out


def name_signals(column: Column, signals: tuple[Signal, ...], kind: Column | None = None) -> Column:
    """Ids of the signals that a name of this entry kind raises, in the pack's order."""

    def raised(s: Signal) -> Column:
        fits = F.lit(True) if kind is None or not s.kinds else kind.isin(*s.kinds)
        return fits & any_name(column, s.names) & ~any_name(column, s.except_)

    return F.filter(F.array(*(F.when(raised(s), F.lit(s.id)) for s in signals)), lambda x: x.isNotNull())


def file_kinds(files: DataFrame, pack: Pack) -> DataFrame:
    """Adds ``file_kind``: the first name pattern, else the extension's kind, else that of a pair of extensions in one folder, else other.

    ``files`` has ``folder`` and ``name``; a pair is two files of one stem, letters of either case.
    """
    low = F.lower("name")
    own = extension(F.col("name"))
    named = F.lit(None).cast("string")
    for kind, globs in reversed(pack.kind_names):
        named = F.when(any_name(F.col("name"), globs), kind).otherwise(named)
    found = F.coalesce(named, mapped(own, pack.kind_of) if pack.kind_of else F.lit(None))
    out = files.withColumns({"granary_stem": F.regexp_replace(low, r"\.[^.]*$", ""), "granary_ext": own, "granary_kind": found})
    for ext, sibling, kind in pack.pairs:
        near = files.where(extension(F.col("name")) == sibling).select(F.col("folder").alias("granary_at"), F.regexp_replace(low, r"\.[^.]*$", "").alias("granary_with")).distinct()
        is_pair = (F.col("granary_ext") == ext) & F.col("granary_with").isNotNull()
        out = out.join(near, (F.col("folder") == F.col("granary_at")) & (F.col("granary_stem") == F.col("granary_with")), "left")
        out = out.withColumn("granary_kind", F.coalesce("granary_kind", F.when(is_pair, kind))).drop("granary_at", "granary_with")
    return out.withColumn("file_kind", F.coalesce("granary_kind", F.lit("other"))).drop("granary_stem", "granary_ext", "granary_kind")


def _tally(rules: tuple[Rule, ...], matches: list[Column]) -> Column:
    """Matching rules as structs, highest priority first."""
    order = sorted(range(len(rules)), key=lambda k: -rules[k].priority)
    one = lambda r: F.struct(
        F.lit(r.id).alias("id"), F.lit(r.priority).alias("priority"), F.lit(r.category).alias("category"),
        F.array(*(F.lit(t) for t in r.traits)).cast("array<string>").alias("traits"), F.lit(r.review).alias("review"),
    )
    return F.filter(F.array(*(F.when(F.coalesce(matches[k], F.lit(False)), one(rules[k])) for k in order)), lambda x: x.isNotNull())


def resolve(entries: DataFrame, hits: Column) -> DataFrame:
    """Adds ``category``, ``reason``, ``family``, ``triage``, ``traits`` and ``rules`` from the matching rules.

    The highest priority that has a category decides; two categories there
    conflict.  Traits are those of all matching rules.
    """
    top = F.array_max(F.transform(F.filter("granary_hits", lambda h: h["category"] != ""), lambda h: h["priority"]))
    decide = F.filter("granary_hits", lambda h: (h["category"] != "") & (h["priority"] == F.col("granary_top")))
    categories = F.array_distinct(F.transform("granary_decide", lambda h: h["category"]))
    n = F.size("granary_categories")
    traits = F.flatten(F.transform("granary_hits", lambda h: h["traits"]))
    shown = F.filter("granary_hits", lambda h: (F.size(h["traits"]) > 0) | ((h["category"] != "") & (h["priority"] == F.col("granary_top"))))
    review = F.exists("granary_decide", lambda h: h["review"])
    out = entries.withColumn("granary_hits", hits).withColumn("granary_top", top).withColumn("granary_decide", decide).withColumn("granary_categories", categories)
    out = out.withColumn("category", F.when(n == 1, F.get("granary_categories", F.lit(0))).otherwise("unknown"))
    return out.withColumns(
        {
            "reason": F.when(n == 0, "no_rule_matched").when(n > 1, "conflicting_rules").otherwise("matched"),
            "family": mapped(F.col("category"), FAMILY_OF),
            "triage": F.when(review, "review").otherwise(F.coalesce(mapped(F.col("category"), TRIAGE_OF), F.lit("review"))),
            "traits": F.filter(F.array(*(F.when(F.array_contains(traits, t), F.lit(t)) for t in TRAITS)), lambda x: x.isNotNull()),
            "rules": F.transform(shown, lambda h: h["id"]),
        }
    ).drop("granary_hits", "granary_top", "granary_decide", "granary_categories")


def folder_flags(classified: DataFrame) -> DataFrame:
    """``grouped`` by category, and the veto: a folder to discard with user material below (``indicators``) is up for review."""
    veto = (F.col("triage") == "discard") & (F.col("indicators") > 0)
    return classified.withColumns({"grouped": F.col("category").isin(*GROUPED), "veto": veto, "triage": F.when(veto, "review").otherwise(F.col("triage"))})


def classify_files(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Files (``name``, ``file_kind``, ``size``) by the file rules."""

    def match(r: Rule) -> Column:
        out = any_name(F.col("name"), r.names) if r.names else F.lit(True)
        if r.share:
            mine = F.col("file_kind").isin(*r.share.kinds)
            out = out & r.share.holds(F.when(mine, 1).otherwise(0), F.when(mine, F.col("size")).otherwise(0), F.col("size"))
        return out

    return resolve(files, _tally(rules, [match(r) for r in rules]))


def folder_facts(files: DataFrame, signals: tuple[Signal, ...]) -> DataFrame:
    """Per folder (``source_id``, ``folder``): ``name``, ``bytes``, ``indicators`` and maps ``child``, ``below`` (signals), ``kind_files``, ``kind_bytes``."""
    marked = with_ancestors(files.withColumn("granary_signals", name_signals(name(F.col("path")), signals))).withColumnRenamed("ancestor", "folder")
    by = ["source_id", "folder"]
    is_child = parent(F.col("path")) == F.col("folder")
    as_map = lambda k, *vs: [F.map_from_entries(F.collect_list(F.struct(k, v))).alias(v) for v in vs]
    kinds = marked.groupBy(*by, "file_kind").agg(F.count(F.lit(1)).alias("kind_files"), F.sum("size").alias("kind_bytes"))
    kinds = kinds.groupBy(*by).agg(F.sum("kind_bytes").alias("bytes"), *as_map("file_kind", "kind_files", "kind_bytes"))
    raised = marked.select(*by, F.explode("granary_signals").alias("signal"), is_child.alias("direct")).groupBy(*by, "signal").agg(F.count_if("direct").alias("child"), F.count(F.lit(1)).alias("below"))
    tells = F.col("signal").isin(*(s.id for s in signals if s.indicator)) if any(s.indicator for s in signals) else F.lit(False)
    raised = raised.groupBy(*by).agg(*as_map("signal", "child", "below"), F.sum(F.when(tells, F.col("below")).otherwise(0)).alias("indicators"))
    return kinds.join(raised, by, "left").withColumns({"name": name(F.col("folder")), "indicators": F.coalesce("indicators", F.lit(0))})


def classify_folders(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Folders by the folder rules, with their flags (C4)."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))

    def match(r: Rule) -> Column:
        out = any_name(F.col("name"), r.names) if r.names else F.lit(True)
        for s in r.child_all:
            out = out & (at("child", s) > 0)
        for s in r.child_none:
            out = out & (at("child", s) == 0)
        if r.child_any:
            some = F.lit(False)
            for s in r.child_any:
                some = some | (at("child", s) > 0)
            out = out & some
        for s, least in r.subtree.items():
            out = out & (at("below", s) >= least)
        if r.share:
            total = lambda m: sum((at(m, k) for k in r.share.kinds[1:]), at(m, r.share.kinds[0]))
            out = out & r.share.holds(total("kind_files"), total("kind_bytes"), F.col("bytes"))
        return out

    return folder_flags(resolve(facts, _tally(rules, [match(r) for r in rules])))


def recall(entries: DataFrame, rules: tuple[Rule, ...], column: str = "rules") -> DataFrame:
    """The result that stored rule ids gave; ids that the pack does not define are ignored."""
    return resolve(entries, _tally(rules, [F.array_contains(column, r.id) for r in rules]))


def explained(column: str, rules: tuple[Rule, ...]) -> Column:
    """For each rule id its sentence, empty where the pack has none (PJ12)."""
    table = {r.id: r.explain for r in rules}
    return F.transform(column, lambda i: F.coalesce(mapped(i, table), F.lit("")))


def apply_owner(classified: DataFrame) -> DataFrame:
    """The owner's category (``own_category``) replaces the rules', family and triage follow; the owner's group mark (``own_group``) replaces the folder's."""
    own = F.col("own_category").isNotNull()
    out = classified.withColumn("category", F.coalesce("own_category", "category"))
    out = out.withColumns(
        {
            "family": F.when(own, mapped(F.col("category"), FAMILY_OF)).otherwise(F.col("family")),
            "granary_plain": F.when(own, F.coalesce(mapped(F.col("category"), TRIAGE_OF), F.lit("review"))),
        }
    )
    veto = F.when(own, (F.col("granary_plain") == "discard") & (F.col("indicators") > 0)).otherwise(F.col("veto"))
    triage = F.when(own, F.when(veto, "review").otherwise(F.col("granary_plain"))).otherwise(F.col("triage"))
    grouped = F.coalesce(F.col("own_group"), F.when(own, F.col("category").isin(*GROUPED)).otherwise(F.col("grouped")))
    return out.withColumns({"veto": veto, "triage": triage, "grouped": grouped}).drop("granary_plain")


def notable_signals(traits: Column, indicators: Column, most: int = 2) -> Column:
    """Traits worth naming in a fixed order, then distinct indicator signals: the first two (PJ10)."""
    told = [F.when(F.array_contains(traits, t), F.lit(t)) for t in ("contains_vcs", "contains_database", "contains_credentials", "contains_user_material")]
    named = F.filter(F.array(*told), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(named, F.coalesce(indicators, F.array().cast("array<string>")))), 1, most)


