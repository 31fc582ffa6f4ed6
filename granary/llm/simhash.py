"""SimHash near-duplicates with Golay-code fuzzy keys.

Fingerprint: 64 bits, bit b set where over half of a text's word shingles
(repeats count) have bit b in their XXH64.  A text without words has
fingerprint zero.

Search: the 64 bits are three segments of 22, 21 and 21 bits.  A segment,
padded to 23 bits, is decoded in the perfect binary Golay code to the indices of
all codewords within four bits: one or six keys, and two segments that differ in
up to two bits always share one.  Of four differing bits over three segments,
either one segment has none and another two at most (key: the equal segment and
a Golay index of the other), or two segments have exactly one each (one of the
two documents flips each bit of the first in turn and takes the nearest
codeword of the second).  So every pair within four bits meets in some key, and
a key has 33 to 34 bits, which keeps chance meetings rare.  Each meeting is
verified on the whole fingerprints.

Equal fingerprints are merged first.  Within a key, every member is compared
with the key's smallest fingerprint; after the components of those links are
known, only keys that still hold several components compare the members outside
the largest component with the rest.  Links found that way are all that
components can depend on, and a key crowded with near copies never gives all
its pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, partitions, slices, text_name, without
from granary.llm.graph import components

#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 4
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words divided by the generator: the syndrome, 11 bits."""
    rest = words.copy()
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ (GENERATOR << (k - 11)), rest)
    return rest


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 12 upper bits; for each syndrome its only error of up to three bits, and its
    errors of four bits (five where the first has three bits, else none: -1)."""
    upper = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)
    near = np.zeros(1 << 11, np.int64)
    far = np.full((1 << 11, 5), -1, np.int64)
    count = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << k for k in bits) for bits in itertools.combinations(range(23), weight)])
        for e, s in zip(errors.tolist(), _remainder(errors).tolist(), strict=True):
            if weight < 4:
                near[s] = e
            elif near[s].bit_count() == 3:
                far[s, count[s]] = e
                count[s] += 1
    return upper, near, far


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    upper, near, _ = golay()
    return (words ^ near[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def indices(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, codeword index): all codewords within four bits of each, one or six."""
    upper, near, far = golay()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    yield np.arange(len(words)), (words ^ near[syndrome]) >> 11
    for errors in far[syndrome].T:
        have = np.flatnonzero(errors >= 0)
        yield have, (words[have] ^ errors[have]) >> 11


def shingle_votes(text: str, width: int) -> int:
    """Fingerprint of one text; only A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = np.array([digest(b" ".join(words), 42)], ">u8")
    else:
        hashes = np.fromiter((digest(b" ".join(words[k : k + width]), 42) for k in range(n)), ">u8", n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        votes += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp`` (the 64 bits as a long) of every row; null text has no words."""
    return _marked(docs, width, id_col, text_col).select(F.col("id").alias(id_col), "fp")


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``name`` of the text and ``fp``."""
    rows = docs.select(F.col(id_col).alias("id"), text_name(text_col).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [shingle_votes(t.as_py(), width) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "name", "fp"])

    return rows.mapInArrow(run, f"id {kind}, name binary, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fps``) of every key; a key is table, exact segment and Golay index in one integer."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    at = np.arange(len(fps))
    keys, owners = [], []
    for table, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
        exact = (np.int64(table) << 34 | parts[x]) << 12
        for which, index in indices(parts[y]):
            keys.append(exact[which] | index)
            owners.append(which)
        if x < y:
            centre = nearest(parts[y])
            for bit in range(SEGMENTS[x][1]):
                keys.append(((np.int64(table) << 34 | (parts[x] ^ (1 << bit))) << 12) | centre)
                owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


def links(fps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct ``fp`` within MOST_BITS bits of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy()
            for k in range(0, len(all_fps), 8192):
                own = all_fps[k : k + 8192]
                keys, owners = keys_of(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[owners])], ["key", "fp"])

    by_key = Window.partitionBy("key")
    shared = checkpoint(
        fps.select("fp")
        .repartition(partitions(fps.sparkSession))
        .mapInArrow(run, "key long, fp long")
        .withColumn("pivot", F.min("fp").over(by_key))
        .withColumn("last", F.max("fp").over(by_key))
        .where("pivot <> last")
        .select("key", "fp", "pivot")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    starred = checkpoint(shared.where("fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).where(near).distinct())
    found = components(starred).select(F.col("node").alias("fp"), "root")
    member = shared.select("key", "fp").distinct().join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members"))
        # two members were compared already, each being pivot or not
        .where("roots > 1 and members > 2")
    )
    open_keys = checkpoint(member.join(mixed.select("key", "main"), "key"))
    outside = open_keys.where("root <> main").select("key", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    every = open_keys.select("key", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    rest = outside.join(every, "key").where("root_a <> root_b").where(near).select("a", "b").distinct()
    return starred.unionByName(rest)


def near_groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fp`` and ``component_id``: the smallest id that links of MOST_BITS bits reach.

    Null ids are grouped but never lend their id.  Repeated rows share one fate.
    """
    return _grouped(docs, width, id_col, text_col).select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def _grouped(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's ``id``, ``name`` and ``fp`` with the ``first`` (id, name) of its component."""
    marked = checkpoint(_marked(docs, width, id_col, text_col))
    classes = checkpoint(marked.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "name"))).alias("first")))
    found = components(links(classes)).select(F.col("node").alias("fp"), "root")
    joined = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("first"))
    named = checkpoint(joined.drop("first").join(lowest, "root").select("fp", "first"))
    return marked.join(named, "fp").select("id", "name", "fp", "first")


def drop_near_copies(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id (of its texts the one with the smallest hash); columns unchanged, null ids stay."""
    rows = _grouped(docs, width, id_col, text_col).where("id is not null")
    per_row = checkpoint(rows.groupBy(F.col("id").alias("row_id"), "name").agg(F.bool_and((F.col("id") == F.col("first.id")) & (F.col("name") == F.col("first.name"))).alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    return without(docs, per_row.where("not kept").select("row_id", "name"), per_row.where("kept").select("row_id", "name"), id_col, text_col)
