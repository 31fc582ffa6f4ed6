"""SentencePiece, the manifest and fill-in-middle against the library, a plain tree and a plain rewrite."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import fill_in_middle, manifest, queries, sentencepiece_bpe

ROWS = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, tree string, place string, hash string, n long, form string, path string, cut string"
REST = ("a", "b", "c", "d", "e", 9, "f", "g", "h")
AWKWARD = [None, "", " ", " \n\t ", "a", "a", " a ", "  two  spaces\n\n", "naïve 北京 é 👍🏽 \x00 \x1c", "x" * 20_000, "one two\tthree " * 3000, "a<P> b", "<S>", "x <M>", "▁a ▁▁", " " * 90]


def make(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with further columns that use the operators' own names."""
    return spark.createDataFrame([(*r, *REST) for r in rows], ROWS).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en", None, 3) for k, t in enumerate(AWKWARD)]
    return make(spark, [*rows, rows[4], (None, "no id", None, "s", None), (None, "no id", None, "s", None)]).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# --- 11


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_bpe.Codec(queries.vocabulary_path("piece_bpe_32k.model"))


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<i4").tolist()


def test_sentencepiece_equals_the_library(docs, awkward, library):
    path = queries.vocabulary_path("piece_bpe_32k.model")
    for table in (docs, awkward, docs.limit(0)):
        both = table.select("doc_id", "text").collect()
        out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(table, path), path).collect()
        want = [(r.doc_id, x := library.encode(r.text or ""), len(x), library.decode(x)) for r in both]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, list(r.token_ids), r.n_tokens, r.decoded)) for r in out)


def test_sentencepiece_on_odd_mixtures(codec, library):
    rng = random.Random(3)
    parts = ["a", "b", "th", "e ", "  ", " ", "\n", "é", "北", "👍", "\x00", "▁", "ing", "<s>", "<0x0A>", "�", "⁇"]
    pieces = codec.names[259:]
    for _ in range(3000):
        for text in ("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8)))):
            found = ids(codec, text)
            assert found == library.encode(text), repr(text)
            assert codec.decode(found) == library.decode(found)
    for n in range(1, 120):
        for text in (" " * n, f"a{' ' * n}b", f"{' ' * n}\n{' ' * n}x"):
            assert ids(codec, text) == library.encode(text)


def test_sentencepiece_decodes_any_ids(codec, library):
    rng = random.Random(5)
    for _ in range(5000):
        some = [rng.randrange(260) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(some) == library.decode(some), some


def test_sentencepiece_of_long_fragments_is_linear(codec, library):
    rng = random.Random(1)
    for text in ("".join(rng.choice("abcdehist") for _ in range(100_000)), "aaab" * 20_000, "北京" * 20_000):
        assert ids(codec, text) == library.encode(text)


def test_sentencepiece_tables_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "SEEN_FRAGMENTS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "SEEN_PAIRS", 2)
    small = sentencepiece_bpe.Codec(queries.vocabulary_path("piece_bpe_32k.model"))
    text = "the internationalisation of many different words that do not repeat"
    assert ids(small, text) == library.encode(text)
    assert len(small.seen) <= 3 and len(small.pairs) <= 2


# --- 12


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 16
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + 16])))
        place //= 16
    return out


def plain_manifest(rows):
    leaf = lambda r, t: h("".join(field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, t)))
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    members = {k: sorted(groups[k], key=lambda x: x[:3]) for k in names}
    trees = {k: plain_tree([m[2] for m in members[k]]) for k in names}
    top = plain_tree([trees[k][-1][0] for k in names]) if names else None
    out = []
    for i, k in enumerate(names):
        for place, (_, _, own, r) in enumerate(members[k]):
            path = plain_path(trees[k], place) + plain_path(top, i)
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            fold = leaf(r, lower(r.text)) if changed else own
            for before, after in path:
                fold = h(before + fold + after)
            root = top[-1][0]
            out.append((r.doc_id, own, trees[k][-1][0], root, h("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def found_manifest(table):
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = {"text": manifest.ascii_lower(F.col("text"))}
    v = manifest.verify(table, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", changed, fifth)
    out = v.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_manifest_equals_a_plain_tree(spark, docs, awkward):
    rng = random.Random(1)
    odd = [(rng.choice([None, k, 5]), rng.choice([None, "", "Ab", "É x"]), None, rng.choice([None, "", "a", "=", "Z", "é", *map(str, range(40))]), k) for k in range(400)]
    for table in (docs, awkward, make(spark, odd), docs.limit(0), make(spark, [(1, "A", None, None, None)])):
        assert found_manifest(table) == plain_manifest(table.collect())


def test_manifest_of_a_hot_source_over_many_blocks(spark, monkeypatch):
    """Two thirds of the rows in one source, more than a block of leaves; and blocks of one level, many rounds."""
    rows = make(spark, [(k, f"T{k}", "x", "hot" if k % 3 else f"s{k % 50}", k) for k in range(6500)])
    want = plain_manifest(rows.collect())
    assert found_manifest(rows) == want
    monkeypatch.setattr(manifest, "DEPTH", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    assert found_manifest(rows) == want


def test_manifest_tells_tampering(docs):
    found = {r[0]: r[-1] for r in found_manifest(docs)}
    for r in docs.collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and lower(r.text) != r.text
        assert found[r.doc_id] == (not changed)


# --- 13


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, text)
    if d[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_in_middle_equals_a_plain_rewrite(spark, docs, awkward):
    mixed = make(spark, [(k, f"w {k} 北京\né " * (k % 7) + " " * (k % 3), None, None, 0) for k in range(300)])
    for table in (docs, awkward, mixed, docs.limit(0)):
        out = fill_in_middle.transform(table).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr(plain_middle(r.doc_id, r.text)) for r in table.collect())


def test_cuts_do_not_depend_on_the_pieces_of_a_batch(docs, monkeypatch):
    texts = pa.array(["", "a b", *(r.text or "" for r in docs.collect()), " "])[1:]
    draws = pa.array(range(7, 7 + len(texts)), pa.int64())
    whole = fill_in_middle.cuts(texts, draws, draws)
    for size in (1, 3000):
        monkeypatch.setattr(fill_in_middle, "PIECE_BYTES", size)
        assert fill_in_middle.cuts(texts, draws, draws) == whole
    assert len(fill_in_middle.cuts(texts[:0], draws[:0], draws[:0])) == 0


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 1024, 5000):
        for share in (0, 0.01, 0.5, 1):
            bits = rng.random(n) < share
            v = fill_in_middle.BitVector(bits)
            assert (v.rank(np.arange(n + 1)) == np.concatenate([[0], bits.cumsum()])).all()
            ones = np.flatnonzero(bits)
            assert (v.select(np.arange(1, len(ones) + 1)) == ones).all()
