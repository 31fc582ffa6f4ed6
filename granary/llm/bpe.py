"""Byte-pair encoding and decoding with forced boundaries.

A text becomes a row of byte symbols (512 of them: each byte, plain or ending a
word).  Two neighbours that stand side by side in no token of the vocabulary
can never be merged, so a cut between them is certain.  The fragments between
cuts are encoded by themselves and their ids are concatenated; fragments repeat
a lot, so each Python worker keeps a bounded table of those it has seen.

The vocabulary file is a JSON file of a byte-level BPE with word ends.  Null
text counts as empty and gives no tokens.  Ids travel packed, as little-endian
unsigned 32-bit integers in one binary value.  A very long fragment (one letter
over and over, a script without spaces) takes time in proportion to its length
times its logarithm.  Null and repeated ids are rows like any other.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import slices

#: Words and fragments kept per worker; a full table is emptied.
SEEN_WORDS, SEEN_FRAGMENTS = 400_000, 50_000
#: Symbols from which on a fragment's pairs wait in a heap.
LONG = 48
#: Ranks after every join.
NO_JOIN = (1 << 60, -1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """Tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.base = [vocab[c] for c in letters] + [vocab[c + self.end] for c in letters]
        self.joins = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.joins[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.can_meet = np.zeros((512, 512), bool)
        for token in vocab:
            s = self._symbols(token)
            for pair in zip(s, s[1:], strict=False):
                self.can_meet[pair] = True
        self.meets = [row.tobytes() for row in self.can_meet]
        piece = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(piece.replace(r"\s", r"\p{White_Space}")).findall
        self.gaps = regex.compile(r"\p{White_Space}+").sub
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.fragments: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}

    def _symbols(self, token: str) -> list[int]:
        ends = token.endswith(self.end) and len(token) > len(self.end)
        s = [self.byte_of[c] for c in (token[: -len(self.end)] if ends else token)]
        if ends:
            s[-1] += 256
        return s

    def merge(self, symbols: tuple[int, ...]) -> tuple[int, ...]:
        """Ids of one fragment: join the lowest-ranked pair, leftmost first, until none is left."""
        ids = [self.base[s] for s in symbols]
        if len(ids) >= LONG:
            return self.merge_long(ids)
        # what each pair of neighbours joins to, as (rank, id); a join renews only the two pairs beside it
        joins, none = self.joins, NO_JOIN
        found = [joins.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = joins.get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = joins.get((ids[k], ids[k + 1]), none)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same over a linked list: a joined pair renews only its two neighbours."""
        n, joins = len(ids), self.joins
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(joins[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in joins]
        heapq.heapify(waiting)
        while waiting:
            _, k, x, y = heapq.heappop(waiting)
            right = after[k]
            if ids[k] != x or right >= n or ids[right] != y:
                continue  # one of the two has been joined meanwhile
            ids[k], ids[right] = joins[x, y][1], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (pair := (ids[left], ids[after[left]])) in joins:
                    heapq.heappush(waiting, (joins[pair][0], left, *pair))
        return tuple(i for i in ids if i >= 0)

    def word(self, piece: str) -> list[int]:
        """Ids of one piece between white space and class changes."""
        symbols = list(piece.encode())
        symbols[-1] += 256
        start, out, meets, n = 0, [], self.meets, len(symbols)
        for k in range(1, n + 1):
            if k == n or not meets[symbols[k - 1]][symbols[k]]:
                fragment = tuple(symbols[start:k])
                if (ids := self.fragments.get(fragment)) is None:
                    if len(self.fragments) >= SEEN_FRAGMENTS:
                        self.fragments.clear()
                    ids = self.merge(fragment)
                    if len(fragment) <= 64:
                        self.fragments[fragment] = ids
                out += ids
                start = k
        return out

    def unseen(self, word: str) -> bytes:
        ids = [i for piece in self.pieces(word) for i in self.word(piece)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= SEEN_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letter by letter, a capital sigma has one small form
            return "".join(map(str.lower, text))
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; the special strings of the file stand for themselves."""
        parts = self.specials(text) if any(s in text for s in self.special) else [text]
        seen, out = self.words, []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for w in self.gaps(" ", self.normal(part)).split(" "):
                if w:
                    packed = seen.get(w)
                    out.append(self.unseen(w) if packed is None else packed)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Token names joined by one space, as the file names no decoder; ids beyond it are left out."""
        n, names = len(self.names), self.names
        return " ".join([names[i] for i in np.frombuffer(packed, "<u4").tolist() if i < n and names[i]])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The tables of a file, read once per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``token_ids`` (packed) and ``n_tokens`` of every row; whole texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            packed = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())],
                ["id", "token_ids", "n_tokens"],
            )

    out = rows.mapInArrow(run, f"id {id_type}, token_ids binary, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded``, the text that the ids in ``ids_col`` name, to every row."""
    schema = encoded.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",decoded:string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            texts = [c.decode(x.as_py() or b"") for x in b.column(b.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
