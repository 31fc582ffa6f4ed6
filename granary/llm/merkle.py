"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A section ends at a blank line, a paragraph at a line end, and a paragraph is
cut into pieces of ``PIECE`` code points from its start; piece, paragraph,
section and document hashes are each the hash of the level below.  Equal roots
mean equal texts.  Two trees are compared from the top: equal branches count
whole, differing branches are opened, and what differs at the bottom is where
the edit is.

Null text counts as empty.  The next document of a table is the next in
ascending (id, text); after the last comes the first; a lone document follows
itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, slices

PIECE = 48


def _hash(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


def tree(text: str) -> tuple[bytes, list]:
    """(root, sections); a section is (hash, paragraphs), a paragraph (hash, [(piece hash, length)])."""
    sections = []
    for block in text.split("\n\n"):
        paragraphs = []
        for line in block.split("\n"):
            leaves = [
                (hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(part))
                for part in (line[k : k + PIECE] for k in range(0, len(line) or 1, PIECE))
            ]
            paragraphs.append((_hash(b"p", [h for h, _ in leaves]), leaves))
        sections.append((_hash(b"s", [h for h, _ in paragraphs]), paragraphs))
    return _hash(b"d", [h for h, _ in sections]), sections


def differing(a: tuple, b: tuple) -> tuple[list, list]:
    """Leaves of either tree that lie in branches the other one lacks."""
    if a[0] == b[0]:
        return [], []
    out = []
    for x, y in ((a, b), (b, a)):
        sections = Counter(h for h, _ in y[1])
        opened = []
        for h, paragraphs in x[1]:
            if sections[h] > 0:
                sections[h] -= 1
            else:
                opened += paragraphs
        out.append(opened)
    leaves = []
    for x, y in (out, out[::-1]):
        same = Counter(h for h, _ in y)
        opened = []
        for h, pieces in x:
            if same[h] > 0:
                same[h] -= 1
            else:
                opened += pieces
        leaves.append(opened)
    return leaves[0], leaves[1]


def likeness(a: tuple, b: tuple, chars: int) -> float:
    """Share of both texts' code points (``chars`` in all) in pieces that both have; 1 for equal roots."""
    if a[0] == b[0]:
        return 1.0
    left, right = differing(a, b)
    have = Counter(h for h, _ in right)
    lost = sum(n for _, n in left) + sum(n for _, n in right)
    for h, n in left:
        if have[h] > 0:
            have[h] -= 1
            lost -= 2 * n
    return max(0.0, 1.0 - lost / chars) if chars else 0.0


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fingerprint`` (root, hex) and ``sections``: every node of the tree, for locating edits."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            trees = [tree(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([t[0].hex() for t in trees]),
                    pa.array(
                        [[{"hash": h.hex(), "paragraphs": [{"hash": p.hex(), "pieces": [x.hex() for x, _ in ps]} for p, ps in par]} for h, par in t[1]] for t in trees],
                        pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(pa.struct([("hash", pa.string()), ("pieces", pa.list_(pa.string()))])))])),
                    ),
                ],
                ["id", "fingerprint", "sections"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, fingerprint string, sections array<struct<hash:string,paragraphs:array<struct<hash:string,pieces:array<string>>>>>"
    ).withColumnRenamed("id", id_col)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, own: tuple, following: str, other: tuple) -> tuple:
    edited = edited_text(text, following)
    changed = tree(edited)
    return (
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        own[0].hex(),
        changed[0].hex(),
        likeness(own, changed, len(text) + len(edited)),
        likeness(own, other, len(text) + len(following)),
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    One shuffle of the texts, by id range.  A task walks its range in order;
    the pairs that straddle two ranges (at most two rows per task) are matched
    afterwards.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch(id_type: pa.DataType, edges: list, ids: list, texts: list, results: list) -> pa.RecordBatch:
        columns = [pa.array([r and r[k] for r in results], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(
            [pa.array(edges, pa.int64()), pa.array(ids, id_type), pa.array(texts, pa.string()), *columns], ["edge", "id", "body", *fields]
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = id_type = None
        for b in slices(batches):
            ids, results = [], []
            id_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = tree(text)
                if last is None:
                    yield batch(id_type, [2 * part], [key], [text], [None])
                else:
                    ids.append(last[0])
                    results.append(_compare(last[1], last[2], text, own))
                last = (key, text, own)
            yield batch(id_type, [None] * len(ids), ids, [None] * len(ids), results)
        if last:
            yield batch(id_type, [2 * part + 1], [last[0]], [last[1]], [None])

    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "body")
    walked = checkpoint(ordered.mapInArrow(walk, f"edge long, id {kind}, body string, {_RESULT}"))
    edges = walked.where("edge is not null").select("edge", "id", "body")
    # Only the numbers of the edges, two per task, meet in one place; their texts are joined.
    first = edges.agg(F.min("edge").alias("first"))
    turn = edges.select("edge").withColumn("next", F.lead("edge").over(Window.orderBy("edge")))
    turn = turn.where("edge % 2 = 1").join(F.broadcast(first)).select("edge", F.coalesce("next", "first").alias("next"))
    pairs = (
        edges.join(turn, "edge")
        .join(edges.select(F.col("edge").alias("next"), F.col("body").alias("following")), "next")
        .select("id", "body", "following")
    )

    def straddle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            results = [_compare(t, tree(t), f, tree(f)) for t, f in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in results], t) for k, t in enumerate(types))], ["id", *fields])

    rest = pairs.mapInArrow(straddle, f"id {kind}, {_RESULT}")
    return walked.where("edge is null").select("id", *fields).unionByName(rest).withColumnRenamed("id", id_col)
