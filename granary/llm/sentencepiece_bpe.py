"""SentencePiece (BPE) encoding and decoding by a table of last tokens.

The encoding of every prefix of a text ends in exactly one token.  An automaton
over all pieces gives the pieces that end at each place; the one whose forerunner
(the last token of what lies before it) stays beside it when the two are merged
by themselves is the last token there.  The table is filled from left to right in
time in proportion to the length, and the ids are read from its end backwards.

Whether two tokens stay beside each other is told from their merge trees: going
back in time from the whole tokens, wherever two parts face each other across
the border, no piece may join them before one of the two is used up.  Equal
scores (runs of spaces have one) go by place, leftmost first.

No piece holds a space after another letter, so a text is cut before each run of
spaces, and each worker keeps a bounded table of fragments it has seen.  Letters
that no piece holds are cut out and become byte tokens.  Null text counts as
empty and gives no tokens.  Null and repeated ids are rows like any other.
"""

from __future__ import annotations

import codecs
import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import slices

#: Fragments and pairs of tokens kept per worker; a full table is emptied.
SEEN_FRAGMENTS, SEEN_PAIRS = 400_000, 1_000_000
SPACE = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            yield number, data[at : at + 8]
            at += 8


def _one_mark_per_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("granary-mark-bytes", _one_mark_per_byte)


class Codec:
    """Tables of one model file; a BPE model with byte fallback, no normalisation and spaces kept."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for n, v in parts if n == 1]
        trainer = next(dict(_fields(v)) for n, v in parts if n == 2)
        normal = next(dict(_fields(v)) for n, v in parts if n == 3)
        self.names = [p[1].decode() for p in pieces]
        self.types = [p.get(3, NORMAL) for p in pieces]
        own = [i for i, t in enumerate(self.types) if t == NORMAL]
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError(f"{path} is not a plain BPE model that keeps spaces")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.byte_ids = [self.names.index(f"<0x{b:02X}>") for b in range(256)]
        self.id_of = {self.names[i]: i for i in own}
        scores = sorted({pieces[i].get(2, 0.0) for i in own if len(self.names[i]) > 1}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: When a piece is formed: single letters at once (-1), others by falling score.
        self.rank = [place[pieces[i].get(2, 0.0)] if t == NORMAL and len(self.names[i]) > 1 else -1 for i, t in enumerate(self.types)]
        self.sizes = [len(n) for n in self.names]
        letters = {c for i in own for c in self.names[i]}
        if letters - set(self.id_of):
            raise ValueError(f"{path} has letters inside pieces that are no pieces themselves")
        self.parts = {i: self._last_join(self.names[i]) for i in own if self.sizes[i] > 1}
        if any(self.rank[i] < max(self.rank[a], self.rank[b]) for i, (a, b) in self.parts.items()):
            raise ValueError(f"{path} has pieces that score above their parts")
        self.automaton = ahocorasick.Automaton()
        for i in own:
            self.automaton.add_word(self.names[i], i)
        self.automaton.make_automaton()
        cut = not any(SPACE in self.names[i].lstrip(SPACE) for i in own)
        self.fragments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cut else r"(?s).+").findall
        self.known = re.compile("([^" + "".join(map(re.escape, sorted(letters))) + "]+)").split
        self.seen: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.controls = {i for i, t in enumerate(self.types) if t == CONTROL}
        unknown = trainer.get(44, " ⁇ ".encode())
        self.bytes = [
            bytes([int(n[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else unknown if t == UNKNOWN else n.replace(SPACE, " ").encode()
            for n, t in zip(self.names, self.types, strict=True)
        ]

    def _last_join(self, piece: str) -> tuple[int, int]:
        """The two pieces whose join makes ``piece`` when its letters are merged by themselves."""
        ids = [self.id_of[c] for c in piece]
        while len(ids) > 2:
            _, k = min((self.rank[i], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (i := self._join(*p)) is not None)
            ids[k : k + 2] = [self._join(ids[k], ids[k + 1])]
        return ids[0], ids[1]

    def _join(self, a: int, b: int) -> int | None:
        return self.id_of.get(self.names[a] + self.names[b])

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` and ``b``, merged together, give the two again."""
        rank, used_a, used_b = self.rank, math.inf, math.inf
        while True:
            joined = self._join(a, b)
            # of equal scores the left join goes first: inside a before the border, the border before b
            if joined is not None and rank[joined] < used_a and rank[joined] <= used_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[b] >= rank[a]:
                used_b, b = rank[b], self.parts[b][0]
            else:
                used_a, a = rank[a], self.parts[a][1]

    def known_ids(self, text: str) -> list[int]:
        """Ids of a text of known letters: the last token of each prefix, then back from the end."""
        last, sizes, pairs = [-1] * (len(text) + 1), self.sizes, self.pairs
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - sizes[token]]
                if before >= 0:
                    fits = pairs.get((before, token))
                    if fits is None:
                        if len(pairs) >= SEEN_PAIRS:
                            pairs.clear()
                        fits = pairs[before, token] = self.stay_apart(before, token)
                    if not fits:
                        continue
                last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return ids[::-1]

    def fragment(self, text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(self.known(text)):
            if k % 2:
                ids += [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
            elif part:
                ids += self.known_ids(part)
        packed = np.array(ids, "<i4").tobytes()
        if len(text) <= 64:
            if len(self.seen) >= SEEN_FRAGMENTS:
                self.seen.clear()
            self.seen[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids."""
        if not text:
            return b""
        seen = self.seen.get
        return b"".join([seen(f) or self.fragment(f) for f in self.fragments(self.prefix + text.replace(" ", SPACE))])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one mark U+FFFD per byte that is no UTF-8, and the leading space put in front taken off."""
        table, runs = self.bytes, [[]]
        if self.controls.isdisjoint(ids):
            runs = [ids]
        else:  # a control token is nothing, but bytes on either side of it form no letter
            for i in ids:
                runs.append([]) if i in self.controls else runs[-1].append(i)
        text = "".join([b"".join([table[i] for i in run]).decode("utf-8", "granary-mark-bytes") for run in runs])
        if self.prefix and text.startswith(" "):
            first = next(i for i in ids if table[i])
            if self.types[first] == NORMAL:
                return text[1:]
        return text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The tables of a file, read once per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``token_ids`` and ``n_tokens`` of every row; whole texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            packed = [c.encode(t.as_py()) for t in b.column(1)]
            n = np.array([len(p) // 4 for p in packed], np.int64)
            ids = np.frombuffer(b"".join(packed), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(n)], ["id", "token_ids", "n_tokens"])

    out = rows.mapInArrow(run, f"id {id_type}, token_ids array<int>, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded``, the text that the ids in ``ids_col`` name; null ids give the empty text."""
    schema = encoded.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",decoded:string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            texts = [c.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in b.column(b.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
