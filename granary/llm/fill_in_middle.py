"""Fill-in-the-middle transformation with succinct rank and select.

A unit is a word with the white space before it, or the white space that ends a
text.  Unit ends are marked in a bit vector over the bytes of a batch of texts,
one bit a byte, packed, with a directory of the marks before each block of 512
bits.  Rank (the marks before a place) at a text's ends gives its number of units
n; the two cuts drawn are ranks, and select (the place of the k-th mark) turns
them into byte cuts, wherever the characters lie.

The draws come from the sha256 of seed and id, so a row's form and cuts do not
depend on order, partitioning or retries.  Texts that hold a marker, empty and
null texts stay plain, so every output is turned back into its text by
``restored``.  A null id draws as the empty id.  Repeated ids draw alike.  One
projection: no shuffle, no state; a batch is worked through in pieces of
bounded bytes, a single longer text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MARKERS = ("<P>", "<S>", "<M>")
#: Bits of a block of the directory, and bytes of text handled at once.
BLOCK, PIECE_BYTES = 512, 16 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class BitVector:
    """Packed bits with the count of ones before each block: rank and select for arrays of questions."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        self.packed = np.packbits(bits, bitorder="little")
        self.packed = np.pad(self.packed, (0, -len(self.packed) % (BLOCK // 8) or (0 if len(self.packed) else BLOCK // 8)))
        ones = _ONES[self.packed].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], ones.cumsum()])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to size)."""
        places = np.asarray(places, np.int64)
        block, byte = places // BLOCK, places // 8
        whole = np.append(self.packed, np.uint8(0))
        out = self.before[block] + _ONES[whole[byte] & ((1 << (places % 8)) - 1).astype(np.uint8)]
        for k in range(BLOCK // 8 - 1):
            at = block * (BLOCK // 8) + k
            out += np.where(at < byte, _ONES[whole[np.minimum(at, len(self.packed))]], 0)
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the k-th one, counted from 1: its block by the directory, then its byte, then its bit."""
        ranks = np.asarray(ranks, np.int64)
        block = np.searchsorted(self.before, ranks, "left") - 1
        rest = ranks - self.before[block]
        inside = _ONES[self.packed.reshape(-1, BLOCK // 8)[block]].cumsum(1, dtype=np.int64)
        byte = (inside < rest[:, None]).sum(1)
        rest = rest - np.where(byte > 0, np.take_along_axis(inside, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.unpackbits(self.packed[block * (BLOCK // 8) + byte][:, None], axis=1, bitorder="little").cumsum(1)
        return block * BLOCK + byte * 8 + (bits < rest[:, None]).sum(1)


def unit_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One bit per byte of texts laid end to end: does a unit end with it?  ``starts`` has all starts and the end."""
    white = _WHITE[data]
    last = np.zeros(len(data), bool)
    last[starts[1:][np.diff(starts) > 0] - 1] = True
    ends = last.copy()
    ends[:-1] |= ~white[:-1] & white[1:]
    return ends


def _cut(texts: pa.Array, draw_a: np.ndarray, draw_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, and the two byte cuts of each text."""
    texts = texts.cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    vector = BitVector(unit_ends(data, starts))
    marks = vector.rank(starts)
    n = np.diff(marks)
    a, b = draw_a % (n + 1), draw_b % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place, some = np.zeros(len(n), np.int64), k > 0
        place[some] = vector.select(marks[:-1][some] + k[some]) + 1 - starts[:-1][some]
        cuts.append(place)
    return n, cuts[0], cuts[1]


def cuts(texts: pa.Array, draw_a: pa.Array, draw_b: pa.Array) -> pa.Array:
    """n and two byte cuts: after the smaller and the larger of the draws modulo n + 1 units."""
    out = []
    for start, stop in _pieces(texts):
        part = slice(start, stop)
        out.append(_cut(texts[part], draw_a[part].to_numpy(zero_copy_only=False), draw_b[part].to_numpy(zero_copy_only=False)))
    columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to PIECE_BYTES of text, one row at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > PIECE_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if len(texts):
        yield start, len(texts)


def draw(seed: int, id_col: Column, group: int) -> Column:
    """The ``group``-th 8-digit group (from 1) of the hex sha256 of seed, colon and decimal id, as an integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def _bytes(text: Column, start: Column, stop: Column | None = None) -> Column:
    """The text between two byte cuts."""
    data = text.cast("binary")
    size = F.octet_length(text) if stop is None else stop - start
    return F.substring(data, (start + 1).cast("int"), size.cast("int")).cast("string")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``rate`` per cent of the texts are cut, and ``suffix_first`` per cent of those
    are written as suffix, prefix, middle (spm), the others as prefix, suffix,
    middle (psm).
    """
    p, s, m = MARKERS
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    cut = arrow_udf(cuts, "n long, first long, second long")
    drawn = rows.withColumn("cut", cut("body", draw(seed, F.col("id"), 1), draw(seed, F.col("id"), 2)))
    marked = F.contains("body", F.lit(p)) | F.contains("body", F.lit(s)) | F.contains("body", F.lit(m))
    plain = (F.col("body") == "") | marked | (draw(seed, F.col("id"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(seed, F.col("id"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    prefix, middle, suffix = F.col("prefix"), F.col("middle"), F.col("suffix")
    return (
        drawn.withColumn("form", form)
        .withColumns(
            {
                "prefix": _bytes(F.col("body"), F.lit(0), F.col("cut.first")),
                "middle": _bytes(F.col("body"), F.col("cut.first"), F.col("cut.second")),
                "suffix": _bytes(F.col("body"), F.col("cut.second")),
            }
        )
        .select(
            F.col("id").alias(id_col),
            F.col("cut.n").alias("n"),
            "form",
            F.when(F.col("form") != "plain", F.char_length("prefix")).cast("long").alias("prefix_chars"),
            F.when(F.col("form") != "plain", F.char_length("middle")).cast("long").alias("middle_chars"),
            F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
            .when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
            .otherwise(F.col("body"))
            .alias("output"),
        )
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
