"""Removal of repeated word passages, found by recompression.

A text is a row of word symbols.  Rounds rewrite it: the first names runs of one
word, each later one splits the alphabet in two by a bit of the symbol's name
and joins every neighbouring pair (left class, right class) into a new symbol.
A name is a hash of what it stands for, so equal runs and pairs get equal names
in every task of every round without a dictionary.  Each symbol also carries the
span of words that its making depended on; equal words over that span give the
same symbol anywhere.

Of the symbols whose span lies in a window of consecutive words, the one with
the smallest mixed name stands for the window.  Neighbouring windows mostly
choose the same symbol, so a text gives one row for each such stretch of
windows: the symbol's name and a name of all words the stretch covers.  Equal
windows choose the same symbol.  So a stretch whose symbol occurs once in the
corpus holds no repeated window; one whose words occur again as a stretch of the
same symbol is repeated as a whole; only where a symbol has stretches that
differ (at the ends of a shared passage) are single windows verified, by 128-bit
names of their words, one stretch of each kind.  A window that holds no whole
span is a stretch of its own.

Null text has no words; an empty or short text keeps all it has.  Rows are told
apart by id and text, so ids may be null or repeated; a repeated row is a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, partitions, slices

#: Later rounds make symbols that fewer unrelated texts share, but whose spans fit fewer windows.
ROUNDS = 6
#: No symbol grows beyond so many words, so that every window has whole symbols.
LONGEST = 12
#: Words handled at once within a task.
CHUNK = 1 << 18
#: Buckets of names; one that holds over 1 / (4 x partitions) of the rows of a share of the texts is spread.
BUCKETS = 1 << 16
PROBE = 0.05
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def recompress(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents side by side: names and the spans they depend on.

    ``first`` and ``last`` give, for each word, its document's first word and
    the place after its last one.  What depends on a document's edge gets a span
    that reaches beyond it.
    """
    n = len(names)
    same = np.zeros(n + 1, bool)
    same[1:n] = (names[1:] == names[:-1]) & (first[1:] == first[:-1])
    start = np.flatnonzero(~same[:n])
    stop = np.append(start[1:], n)
    sym, length = names[start], stop - start
    sym = np.where(length > 1, mix(sym + _U(0x9E3779B97F4A7C15) * length.astype(np.uint64)), sym)
    low, high = start - 1, stop + 1  # the words that end a run on either side
    begin, end = first[start], last[start]
    for k in range(ROUNDS):
        right = (mix(sym ^ _U(0xD6E8FEB86659FD93 + k)) & _U(1)).astype(bool)
        inner = begin[1:] == begin[:-1]
        join = inner & ~right[:-1] & right[1:] & (length[:-1] + length[1:] <= LONGEST)
        head = np.append(join, False)
        tail = np.append(False, join)
        lone = ~head & ~tail
        beyond_low = np.append(begin[:1] - 1, np.where(inner, low[:-1], begin[1:] - 1))
        beyond_high = np.append(np.where(inner, high[1:], end[:-1] + 1), end[-1:] + 1)
        new_low = np.where(lone & right, np.minimum(low, beyond_low), low)
        new_high = np.where(lone & ~right, np.maximum(high, beyond_high), high)
        at = np.flatnonzero(head)
        sym = sym.copy()
        sym[at] = mix(mix(sym[at] + _U(k + 1)) ^ (sym[at + 1] * _U(0xC2B2AE3D27D4EB4F)))
        length = length.copy()
        length[at] += length[at + 1]
        new_high[at] = high[at + 1]
        stay = ~tail
        sym, length, low, high, begin, end = sym[stay], length[stay], new_low[stay], new_high[stay], begin[stay], end[stay]
    return sym, low, high


def choose(names: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, index of the symbol each chose or -1, symbol names, first word of each span)."""
    at = np.arange(len(names))
    starts = at[at + window <= last]
    if not len(starts):
        return starts, starts, names[:0], starts
    sym, low, high = recompress(names, first, last)
    i = np.searchsorted(low, starts, "left")
    j = np.searchsorted(high, starts + window, "right") - 1
    count = j - i + 1
    index_bits = _U(21)
    key = (mix(sym) >> index_bits << index_bits) | np.arange(len(sym), dtype=np.uint64)
    best = np.full(len(starts), np.iinfo(np.uint64).max, np.uint64)
    width, level = 1, key
    while True:
        have = (count >= width) & (count < 2 * width)
        best[have] = np.minimum(level[i[have]], level[j[have] - width + 1])
        if 2 * width > window or len(level) <= width:
            break
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    chosen = (best & _U((1 << 21) - 1)).astype(np.int64)
    return starts, np.where(count > 0, chosen, -1), sym, low


def names_between(names: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the words in each [start, stop), from running sums of the words' names."""
    out = []
    for base, twist in ((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), (0xD1342543DE82EF95, 0xA0761D6478BD642F)):
        powers = np.full(len(names) + 1, base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(len(names) + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.append(_U(0), np.add.accumulate(mix(names ^ _U(twist)) * powers[:-1]))
        out.append(mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)))
    return out[0], out[1]


def _batches(texts: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first text, words of each text), about CHUNK words together."""
    start, size, held = 0, 0, []
    for k, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").split()
        if held and size + len(words) > CHUNK:
            yield start, held
            start, size, held = k, 0, []
        held.append(words)
        size += len(words)
    if held:
        yield start, held


def _side_by_side(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, owner, first and last of each word, and where each text begins."""
    sizes = np.array([len(w) for w in texts])
    begins = np.append(0, np.cumsum(sizes))
    names = np.concatenate([word_names(w) for w in texts]) if sizes.sum() else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return names, owner, begins[:-1][owner], begins[1:][owner], begins[:-1]


def stretches(texts: list[str], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of windows that chose the same symbol: index of the text, first window, number of
    windows, the symbol's name, the name of the words covered."""
    for at, words in _batches(texts):
        long = [k for k, w in enumerate(words) if len(w) >= 1 << 20]
        for ks in [[k] for k in long] + [[k for k in range(len(words)) if k not in long]]:
            if not ks:
                continue
            names, owner, first, last, begins = _side_by_side([words[k] for k in ks])
            step = (1 << 20) if len(ks) == 1 else len(names) or 1
            for cut in range(0, len(names), step):
                # parts of a very long text overlap by more than any span can reach
                a, b = max(0, cut - 4 * window), min(len(names), cut + step + 4 * window)
                starts, chosen, sym, _ = choose(names[a:b], first[a:b] - a, last[a:b] - a, window)
                own = (starts + a >= cut) & (starts + a < cut + step)
                starts, chosen = starts[own], chosen[own]
                if not len(starts):
                    continue
                new = np.ones(len(starts), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (starts[1:] != starts[:-1] + 1)
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(starts)))
                one, two = names_between(names[a:b], starts[head], starts[head] + count - 1 + window)
                name = np.where(chosen[head] >= 0, sym[chosen[head]], one)
                who = owner[starts[head] + a]
                yield np.array(ks)[who] + at, starts[head] + a - begins[who], count, name, two


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its repeated passages and the text without them.

    Returns id, ``n_words``, ``spans`` (sorted disjoint ``start``/``stop`` word
    places) and ``kept_text`` (the other words, joined by one space).
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).withColumn("text_key", F.xxhash64("body"))
    kind = rows.schema["id"].dataType.simpleString()
    key = ["id", "text_key"]

    def on_key(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.withColumnsRenamed({"id": "other_id", "text_key": "other_key"})
        out = a.join(b, (F.col("text_key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id")), how)
        return out.drop("other_id", "other_key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            for who, first, count, name, words in stretches(b.column(1).to_pylist(), window):
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(words.view(np.int64))],
                    ["id", "text_key", "first", "n", "name", "words"],
                )

    n = partitions(docs.sparkSession)
    found_in = lambda some: some.select("id", "body", "text_key").mapInArrow(find, f"id {kind}, text_key long, first int, n int, name long, words long")
    raw = found_in(rows)
    bucket = F.pmod("name", F.lit(BUCKETS)).cast("int")
    crowds = checkpoint(found_in(rows.sample(PROBE, 6)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")))  # BUCKETS rows at most
    total = crowds.agg(F.sum("rows").alias("all_rows"))
    crowded = crowds.join(F.broadcast(total)).where(F.col("rows") * 4 * n > F.col("all_rows")).select("bucket", F.lit(True).alias("hot"))  # 4 n rows at most
    salted = (
        raw.withColumn("bucket", bucket)
        .join(F.broadcast(crowded), "bucket", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("text_key", "first"), F.lit(n))).otherwise(0).cast("int"))
        .drop("bucket")
    )
    alike = Window.partitionBy("name", "salt", "words")
    counted = checkpoint(
        salted.withColumn("of_name", F.count(F.lit(1)).over(Window.partitionBy("name", "salt")))
        .where("of_name > 1 or hot")
        .withColumn("of_words", F.count(F.lit(1)).over(alike))
        .withColumn("place", F.row_number().over(alike.orderBy("text_key", "first")))
    )
    columns = [*key, "first", "n", "hot", (F.col("of_words") > 1).alias("whole"), ((F.col("of_name") > F.col("of_words")) & (F.col("place") == 1)).alias("verify")]
    # Of the spread names, the totals over all salts; partial sums go before the shuffle.
    spread = counted.where("hot")
    kinds = spread.groupBy("name", "words").agg(F.count(F.lit(1)).alias("of_words"), F.min(F.struct("text_key", "first", "salt")).alias("leader"))
    sums = kinds.groupBy("name").agg(F.sum("of_words").alias("of_name")).where("of_name > 1")
    spread = (
        spread.drop("of_name", "of_words", "place")
        .join(kinds.join(sums, "name"), ["name", "words"])
        .withColumn("place", F.when((F.col("leader.text_key") == F.col("text_key")) & (F.col("leader.first") == F.col("first")), 1).otherwise(2))
    )
    found = checkpoint(counted.where("not hot").select(*columns).unionByName(spread.select(*columns)))
    verify = found.where("verify").groupBy(*key).agg(F.collect_list(F.struct("first", "n", "hot")).alias("ranges"))
    dealt = rows.select("id", "body", "text_key").repartition(n, "text_key")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for k, (text, ranges) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                names = word_names(text.encode("utf-8", "surrogatepass").split())
                at_hot = [np.arange(r["first"], r["first"] + r["n"]) for r in ranges if r["hot"]]
                starts = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in ranges]))
                hot = np.isin(starts, np.concatenate(at_hot)) if at_hot else np.zeros(len(starts), bool)
                one, two = names_between(names, starts, starts + window)
                at = pa.array(np.full(len(starts), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(starts.astype(np.int32)), pa.array(hot), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["id", "text_key", "first", "hot", "one", "two"],
                )

    # Equal windows chose one symbol, so a window that is everywhere has a spread name: it is dealt with a
    # salt too, and counted again by one row per salt.
    by_salt = Window.partitionBy("one", "two", "salt")
    again = (
        on_key(dealt, verify, "inner")
        .mapInArrow(windows, f"id {kind}, text_key long, first int, hot boolean, one long, two long")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("text_key", "first"), F.lit(n))).otherwise(0).cast("int"))
        .withColumn("times", F.count(F.lit(1)).over(by_salt))
        .withColumn("lone", F.col("hot") & (F.col("times") == 1))
        .withColumn("leads", F.col("hot") & (F.row_number().over(by_salt.orderBy("text_key", "first")) == 1))
        .where("times > 1 or lone")
        # The first rows of all salts meet, n of a window at most; the others stay where they are.
        .withColumn("salt", F.when(F.col("leads"), -1).otherwise(F.col("salt")))
        .withColumn("salts", F.count(F.lit(1)).over(by_salt))
        .where("times > 1 or salts > 1")
        .select(*key, "first", F.lit(1).alias("n"))
    )
    gone = found.where("whole").select(*key, "first", "n").unionByName(again).groupBy(*key).agg(F.collect_set(F.struct("first", "n")).alias("ranges"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        for b in slices(batches):
            counts, spans, kept = [], [], []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                found: list[list[int]] = []
                for start, stop in sorted((r["first"], r["first"] + r["n"] - 1 + window) for r in ranges or ()):
                    if found and start <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], stop)
                    else:
                        found.append([start, stop])
                out, at = [], 0
                for start, stop in found:
                    out += words[at:start]
                    at = stop
                counts.append(len(words))
                spans.append([{"start": x, "stop": y} for x, y in found])
                kept.append(b" ".join(out + words[at:]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], ["id", "n_words", "spans", "kept_text"]
            )

    return on_key(dealt, gone, "left").select("id", "body", "ranges").mapInArrow(
        remove, f"id {kind}, n_words long, spans array<struct<start:int,stop:int>>, kept_text string"
    ).withColumnRenamed("id", id_col)
