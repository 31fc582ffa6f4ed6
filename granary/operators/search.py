"""Search: a typed request becomes predicates, an order and a page."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.paths import below, extension, folded

#: Sort key expression and default direction of each order.
ORDERS = {"bytes": ("size", True), "name": ("name", False), "newest": ("mtime_ns", True)}


@dataclass
class Query:
    """All filters combine with AND; a list filter matches any of its values."""

    source: str | None = None
    name: str | None = None
    extensions: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    within: str | None = None
    unreadable: bool = False
    order: str = "bytes"
    descending: bool | None = None

    def validate(self) -> None:
        if self.order not in ORDERS:
            raise ValueError(f"unknown order {self.order!r}")
        if self.min_size is not None and self.max_size is not None and self.min_size > self.max_size:
            raise ValueError("min_size is above max_size")
        if self.name == "":
            raise ValueError("an empty name matches nothing")

    def predicate(self) -> Column:
        self.validate()
        out = F.lit(True)
        if self.source is not None:
            out &= F.col("source_id") == self.source
        if self.name is not None:  # of either case; below three letters accents count
            fold = F.lower if len(self.name) < 3 else folded
            out &= fold(F.col("name")).contains(fold(F.lit(self.name)))
        if self.extensions:
            out &= extension(F.col("name")).isin([e.lower().lstrip(".") for e in self.extensions])
        if self.kinds:
            out &= F.col("kind").isin(self.kinds)
        if self.min_size is not None:
            out &= F.col("size") >= self.min_size
        if self.max_size is not None:
            out &= F.col("size") <= self.max_size
        if self.within is not None:
            out &= below(F.col("path"), self.within)
        if self.unreadable:
            out &= F.col("unreadable")
        return out


def page(entries: DataFrame, q: Query, limit: int = 200, cursor: str | None = None) -> DataFrame:
    """Up to ``limit`` rows strictly after the cursor; ties go by id in the same direction."""
    key, descending = ORDERS[q.order]
    if q.descending is not None:
        descending = q.descending
    rows = entries.where(q.predicate())
    if cursor is not None:
        value, entry = decode_cursor(cursor)
        k, i = F.col(key), F.col("entry_id")
        rows = rows.where((k < value) | ((k == value) & (i < entry)) if descending else (k > value) | ((k == value) & (i > entry)))
    way = F.desc if descending else F.asc
    return rows.orderBy(way(key), way("entry_id")).limit(limit)


def encode_cursor(value: int | str, entry: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, entry]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int | str, int]:
    value, entry = json.loads(base64.urlsafe_b64decode(cursor))
    return value, int(entry)


def capped_count(entries: DataFrame, q: Query, most: int = 10_000) -> DataFrame:
    few = entries.where(q.predicate()).limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    return few.select(F.least("n", F.lit(most)).alias("shown"), (F.col("n") > most).alias("capped"))


def resolve(entries: DataFrame, q: Query, most: int | None = None) -> DataFrame:
    """Ids of every match, ascending, for a selection; more than ``most`` are refused, so it is never a silent subset."""
    found = entries.where(q.predicate()).select("entry_id")
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"the search matches more than {most} entries; narrow it")
    return found.orderBy("entry_id")
