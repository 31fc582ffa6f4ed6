"""Every operator against a brute-force version, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm.common import text_name
from granary.llm import bpe, chat, exact_dedup, graph, language_id, language_model, merkle, mixing, near_dedup, queries, sharding, simhash, substring_dedup

ROWS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, body string, kept boolean, shard int, fp long, rate double"


def make(spark, texts, start=0):
    rows = [(start + k, t, "en", "s", len(t or ""), "x", "y", "z", True, 5, 7, 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ROWS)


AWKWARD = [
    None,
    "",
    " \n\t ",
    "a",
    "a",
    "word " * 200,
    "Same text here, twice over and over.",
    "Same text here, twice over and over.",
    "naïve ÉCOLE straße 北京 \u0130stanbul ΣΑΣ e\u0301 ﬁ 👍🏽 ½",
    "<|startoftext|> inside <|endoftext|>!! it's we'll 12345 \x1c\x85\u3000x",
    "</s>[INST] \\ ok [/INST]",
    "x" * 5000,
    "one two three four five six seven " * 3000,
]


@pytest.fixture(scope="module")
def awkward(spark):
    return make(spark, AWKWARD).unionByName(make(spark, AWKWARD[6:8], 6)).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return (text or "").encode().split()


# --- 1


def test_bpe_equals_the_library(spark, docs, awkward):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    for table in (docs, awkward):
        text = {r.doc_id: r.text or "" for r in table.collect()}
        out = bpe.decode(bpe.encode(table, path), path).collect()
        assert len(out) == table.count()
        for r in out:
            ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
            assert r.n_tokens == len(ids)
            assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    c = bpe.Codec(queries.vocabulary_path())
    assert not c.can_meet.all() and c.can_meet.any()
    for word in ("theinternationale", "zzzqqqxxjk", "straße"):
        symbols = list(word.encode())
        symbols[-1] += 256
        assert c.word(word) == list(c.merge(tuple(symbols)))


def test_bpe_of_very_long_words():
    """A word without any certain cut, and one of random letters, equal the library's within seconds."""
    import time

    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    c, rng = bpe.Codec(path), np.random.default_rng(2)
    for word in ("x" * 200_000, "".join(rng.choice(list("abcdehist"), 200_000)), "北京" * 30_000, "aaab" * 12, "the" * 1000):
        start = time.time()
        mine = np.frombuffer(c.encode(word), "<u4").tolist()
        assert time.time() - start < 20
        assert mine == t.encode(word, add_special_tokens=False).ids


# --- 2


def katz(train, all_texts):
    """Plain dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*words((t or "").translate(low)), "</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        prev = "<s>"
        for w in split(t):
            uni[w] += 1
            bi[prev, w] += 1
            prev = w
    n, v, k = sum(uni.values()), len(uni), language_model.TOP_DISCOUNT

    def table(counts, lowest):
        c = Counter(counts)
        a = (k + 1) * c[k + 1] / c[1] if c[1] else None
        out = {}
        for r in range(1, k + 1):
            d = None
            if a is not None and a < 1 and c[r]:
                d = ((r + 1) * c[r + 1] / (r * c[r]) - a) / (1 - a)
            out[r] = (d if d is not None and 0 < d <= 1 else (r - 0.5) / r) if r >= lowest else 0
        return out

    du, db = table(uni.values(), 1), table(bi.values(), 1)
    left = sum(c * (1 - du.get(c, 1)) for c in uni.values())
    whole = n if left > 0 else n + 1
    unknown = left if left > 0 else 1
    p = lambda w: (uni[w] * du.get(uni[w], 1) if uni[w] else unknown) / whole
    kept = dict(bi)
    have, below, hist = Counter(), Counter(), Counter()
    for (u, w), c in kept.items():
        have[u] += c * db.get(c, 1)
        below[u] += p(w)
    for (u, _), c in bi.items():
        hist[u] += c
    h = {u: c + 1 if have[u] > c - 1e-9 else c for u, c in hist.items()}
    alpha = lambda u: (1 - have[u] / h[u]) / (1 - below[u]) if u in h else 1.0
    out = []
    for t in all_texts:
        prev, s, base, known = "<s>", 0.0, 0.0, 0
        for w in split(t):
            c = kept.get((prev, w))
            s += math.log10(c * db.get(c, 1) / h[prev] if c else alpha(prev) * p(w))
            base += math.log10((uni[w] + 1) / (n + v + 1))
            known += uni[w] > 0
            prev = w
        out.append((len(split(t)), known, n, base, s))
    for u in list(h)[:50]:  # exactly normalised
        total = sum(c * db.get(c, 1) / h[u] for (x, _), c in kept.items() if x == u)
        rest = alpha(u) * (sum(p(w) for w in uni if (u, w) not in kept) + p(None))
        assert abs(total + rest - 1) < 1e-9
    return out


@pytest.mark.parametrize("probe", [0.02, 0.9])
def test_language_model_equals_dictionaries(spark, docs, awkward, monkeypatch, probe):
    """With few and with many words spread over all buckets, and frequent ones broadcast."""
    monkeypatch.setattr(language_model, "PROBE", probe)
    monkeypatch.setattr(language_model, "FREQUENT", 500)
    for table, mod in ((docs, 7), (awkward, 2), (awkward.limit(0), 2), (awkward, 1)):
        rows = table.select("doc_id", "text").collect()
        train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % mod != (2 if mod == 7 else 0)]
        flag = queries.id_bucket("doc_id", mod) != (2 if mod == 7 else 0)
        got = language_model.score(table, flag).collect()
        assert len(got) == len(rows)
        want = sorted((r.doc_id, *w) for r, w in zip(rows, katz(train, [r.text for r in rows]), strict=True))
        mine = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
        for a, b in zip(want, mine, strict=True):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


# --- 3


def test_chat_reads_back_and_shares_prefixes(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi \\ there\n"), (1, 2, "user", "bye"),
        (2, 0, "user", "hello"), (2, 1, "assistant", "hi \\ there\n"), (2, 2, "user", None),
        (3, 0, "user", "hello"), (3, 1, "assistant", "other"),
        (4, 0, None, odd), (4, 1, "assistant", odd), (4, 2, "assistant", "\\</s>\\"),
        (5, 1, "assistant", ""), (5, 1, "assistant", ""), (5, None, "system", "first"),
        (None, 0, "user", "nobody"),
        (6, 0, "user", "hello"), (6, 1, "assistant", "hi \\ there\n"), (6, 2, "user", "bye"),
        *((7, k, ("user", "assistant")[k % 2], f"long {k}") for k in range(300)),
        *((8 + j, k, "user", f"long {k}" if k < 3 * j else f"off {j} {k}") for j in range(9) for k in range(30)),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("path", F.lit("clash")).withColumn("start", F.lit(1))
    nodes, members = chat.prefix_tree(turns)
    listed = nodes.collect()
    stream = {}
    for r in listed:
        assert r.stop - r.start == len(r.segment)
        assert r.position + len(r.segment) == sum(a.stop - a.start for a in r.attends)
        assert [a.start for a in r.attends] == sorted(a.start for a in r.attends) and r.attends[-1].stop == r.stop
        stream[r.start] = r.segment
    order = sorted(stream)
    whole = "".join(stream[k] for k in order)
    attended = {"".join(whole[a.start : a.stop] for a in r.attends) for r in listed}
    assert order[0] == 0 and all(a + len(stream[a]) == b for a, b in zip(order, order[1:], strict=False))
    assert sum("hello" in s for s in stream.values()) == 1
    got = {r.conv: r for r in chat.digests(nodes, members).collect()}
    formatted = {r.conv: r for r in chat.read_back(nodes, members).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        assert formatted[c].formatted == "".join(chat.segment(r, t) for _, r, t in said)
        assert "".join(chat.unescape(formatted[c].formatted[x.start : x.stop]) for x in formatted[c].losses) == "".join(t for _, role, t in said if role == "assistant")
        for k in range(1, len(said) + 1):
            assert "".join(chat.segment(r, t) for _, r, t in said[:k]) in attended
        loss = "".join(t for _, role, t in said if role == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.segment(r, t)) for _, r, t in said)
    # depth-first: after a node come all that follow on it, before anything else
    by_path = {}
    for r in sorted(listed, key=lambda r: r.start):
        path = "".join(whole[a.start : a.stop] for a in r.attends)
        by_path[path] = (r.start, r.stop)
    for path, (start, stop) in by_path.items():
        below = [s for p, s in by_path.items() if p.startswith(path)]
        assert max(b for _, b in below) - start == sum(b - a for a, b in below)
    empty, none = chat.prefix_tree(turns.limit(0))
    assert empty.count() == 0 and chat.read_back(empty, none).count() == chat.digests(empty, none).count() == 0


# --- 4


def test_shards_are_contiguous_and_balanced(spark, docs, awkward, tmp_path):
    for table, shards in ((docs, 24), (docs, 3), (awkward, 24), (awkward.limit(9).union(awkward.limit(9)), 2)):
        rows = sorted((r.doc_id, r.text or "") for r in table.collect())
        lead, size, count = {}, Counter(), Counter()
        for key, text in rows:
            lead[text] = min(key, lead.get(text, key))
            size[text] += len(text.encode()) + 8
            count[text] += 1
        total = sum(size.values())
        units = defaultdict(list)
        for place, (key, text) in enumerate(rows):
            together = count[text] > 1 and size[text] * shards <= sharding.TOGETHER * total
            units[(lead[text], lead[text], 0) if together else (lead[text], key, place)].append((key, len(text.encode()) + 8, zlib.crc32(text.encode())))
        at, want, slots = 0, [], Counter()
        for _, held in sorted(units.items()):
            own = sum(x[1] for x in held)
            shard = min(shards - 1, (2 * at + own) * shards // (2 * total))
            for key, n, crc in sorted(held):
                want.append((key, n, crc, shard, slots[shard]))
                slots[shard] += 1
            at += own
        got = sorted(tuple(r) for r in sharding.assign_shards(table, shards).collect())
        assert got == sorted(want)
    assert sharding.assign_shards(awkward.limit(0)).count() == 0
    # 20,000 empty copies weigh little and stay together; a text that is half of all bytes is cut where the shares end
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    large = spark.range(50_000, 54_000).select(F.col("id").alias("doc_id"), F.lit("y" * 9_000).alias("text"))
    found = sharding.assign_shards(many.unionByName(large).repartition(5), 5).groupBy("text_crc32", "shard").count().collect()
    assert sorted((r.shard, r["count"]) for r in found if r.text_crc32 == 0) == [(0, 20_000)]
    assert [s for s, _ in sorted((r.shard, r["count"]) for r in found if r.text_crc32)] == [0, 1, 2, 3, 4]
    sharding.write_shards(docs, sharding.assign_shards(docs, 4), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()


# --- 5


def fingerprint(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(fps, most=4):
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in fps}


def test_simhash_groups(spark, docs, awkward):
    for table in (docs, awkward):
        fps = {r.doc_id: fingerprint(r.text, 4) for r in table.collect()}
        want = united(fps)
        got = simhash.near_groups(table, 4).collect()
        assert len(got) == table.count()
        for r in got:
            assert (r.fp & (1 << 64) - 1, r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert simhash.near_groups(awkward.limit(0), 4).count() == 0
    left = simhash.drop_near_copies(docs, 4)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(united({r.doc_id: fingerprint(r.text, 4) for r in docs.collect()}).values())


def test_simhash_links_lose_nothing(spark):
    """Chains, balls and chance neighbours of random fingerprints."""
    rng = np.random.default_rng(3)
    fps = set(int(x) for x in rng.integers(0, 1 << 63, 300))
    for base in list(fps)[:12]:
        for _ in range(60):
            for _ in range(int(rng.integers(1, 5))):
                base ^= 1 << int(rng.integers(0, 64))
            fps.add(base)
    centre = 0x0123456789ABCDEF
    for _ in range(400):
        x = centre
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(0, 64))
        fps.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    want = united({signed[x]: x for x in fps})
    table = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(5)
    found = {r.node: r.root for r in graph.components(simhash.links(table)).collect()}
    for s in signed.values():
        assert found.get(s, s) == want[s]


def brute_near(rows, width=5):
    """Smallest id of each component of Jaccard >= 0.8, by all pairs; and the number of such pairs."""
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs, keys = 0, sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n, m = len(sets[a]), len(sets[b])
            if min(n, m) * 5 >= max(n, m) * 4 and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (n + m)):
                pairs += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in sets}, pairs


def test_near_copies_by_likeness(spark, awkward):
    """Edits of every strength, chains, a crowd around one text, and texts just below the bar."""
    rng = np.random.default_rng(8)
    vocab = np.array([f"w{k}" for k in range(400)])
    made = []
    for base in range(40):
        text = list(rng.choice(vocab, int(rng.integers(3, 300))))
        for _ in range(60 if base == 0 else 8):
            made.append(" ".join(text))
            edited = list(text)
            for _ in range(int(rng.integers(0, max(2, len(text) // 20)))):
                edited[int(rng.integers(0, len(edited)))] = str(rng.choice(vocab))
            text = text if base % 2 else edited
            made.append(" ".join(edited))
    table = make(spark, made).repartition(5)
    for t in (table, awkward, awkward.limit(0)):
        want, pairs = brute_near([(r.doc_id, r.text) for r in t.collect()])
        got = near_dedup.near_groups(t).collect()
        assert len(got) == t.count() and {r.doc_id: r.component_id for r in got} == want
        left = near_dedup.drop_near_copies(t)
        assert left.columns == t.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_pipeline_drops_near_copies_at_0_8(spark, sf):
    """The stage against brute force on the pairs of the test table."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    last = 10_000 + max(k for k, _ in rows)
    copies = [(last + k, " ".join(w[: n // 2] + ["changed"] + w[n // 2 + 1 :])) for k, (_, t) in enumerate(rows) if (n := len(w := (t or "").split())) >= 60]
    both = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"), allowMissingColumns=True)
    want, pairs = brute_near(rows + copies)
    assert pairs >= len(copies) > 50
    near = stage.get("near_dedup") or stage["simhash_near_dedup"]
    assert {r.doc_id for r in near(spark, both, sf).collect()} == set(want.values())


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    """All stages over nulls, empty, long and repeated texts, with extra columns of clashing names."""
    import corpus_pipeline

    awkward.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in out}
    assert left and left <= set(range(len(AWKWARD))) and not left & {0, 1, 2, 4, 7}
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in out)


def test_golay_indices():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 23, 3000)
    b = a.copy()
    for _ in range(2):
        b ^= 1 << rng.integers(0, 23, len(a))
    of = []
    for words_ in (a, b):
        sets = [set() for _ in words_]
        for which, index in simhash.indices(words_):
            for k, i in zip(which.tolist(), index.tolist(), strict=True):
                sets[k].add(i)
        of.append(sets)
    assert {len(x) for x in of[0]} == {1, 6}
    assert all(x & y for x, y in zip(*of, strict=True))
    code = np.arange(1 << 12, dtype=np.int64) << 11
    code |= simhash._remainder(code)
    for w in a[:50].tolist():
        distance = [(int(c) ^ w).bit_count() for c in code]
        assert int(np.argmin(distance)) == int(simhash.nearest(np.array([w]))[0]) and min(distance) <= 3


# --- 6


def brute_spans(rows, window):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for key, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((key, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_repeated_passages(spark, docs, awkward):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(60)]
    some = [" ".join(rng.choice(vocab, int(rng.integers(0, 150)))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab, 41))
    some += [f"{a} {passage} {b}" for a, b in zip(some[:20], some[20:40], strict=True)]
    some += ["a b " * 60, "c " * 90, "a b " * 17 + "a", some[3], some[3] + " tail", " ".join(rng.choice(vocab, 36)) * 2]
    for table in (docs, awkward, make(spark, some).repartition(4)):
        for window in (35, 12):
            rows = [(r.doc_id, r.text) for r in table.collect()]
            got = substring_dedup.repeated_spans(table, window).collect()
            mine = sorted((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r.kept_text) for r in got)
            assert mine == brute_spans(rows, window)
    assert substring_dedup.repeated_spans(awkward.limit(0)).count() == 0


def test_stretches_cover_every_window_once():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (4000, 34, 35, 0, 900)]
    got = Counter()
    for who, first, count, _, _ in substring_dedup.stretches(texts, 35):
        for t, f, n in zip(who.tolist(), first.tolist(), count.tolist(), strict=True):
            got.update((t, k) for k in range(f, f + n))
    assert got == Counter((t, k) for t, x in enumerate(texts) for k in range(len(words(x)) - 34))


# --- 7


def test_mixing_meets_targets(spark, sf, awkward):
    large = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    labelled = queries.labelled_domains(spark, large)
    out = mixing.mix(docs, labelled, queries.MIX_TARGETS).collect()
    assert sorted(r.doc_id for r in out) == list(range(docs.count()))
    tokens = sum(r.n_words for r in out)
    assert tokens == sum(len((r.text or "").encode().split()) for r in docs.select("text").collect())
    for d, share in queries.MIX_TARGETS.items():
        assert sum(r.rate * r.n_words * r.posterior[d] for r in out) / tokens == pytest.approx(share, abs=1e-3)
    assert min(r.rate for r in out) >= 0
    assert all(abs(sum(r.posterior.values()) - 1) < 1e-9 for r in out)
    truth = {r.label_id: r.domain for r in labelled.collect()}
    known = [r for r in out if r.doc_id in truth]
    right = sum(max(r.posterior, key=r.posterior.get) == truth[r.doc_id] for r in known)
    assert right / len(known) > 0.85
    none = labelled.limit(0)
    for table in (awkward, awkward.limit(0)):
        rated = mixing.mix(table, none, {"a": 0.5, "b": 0.5})
        assert rated.count() == table.select("doc_id").distinct().count()
        kept = mixing.resample(table, rated)
        assert kept.columns == table.columns


def test_resample_counts(spark):
    docs = make(spark, ["a", "b", "c", "d"])
    rates = docs.where("doc_id < 3").select("doc_id", text_name("text").alias("name"), F.expr("element_at(array(0.49D, 0.5D, 2.2D), cast(doc_id + 1 as int))").alias("rate"))
    assert Counter(r.doc_id for r in mixing.resample(docs, rates).collect()) == {1: 1, 2: 2, 3: 1}


# --- 8


def test_merkle_against_direct(spark, docs, awkward):
    for table in (docs, awkward, awkward.where("doc_id = 3"), awkward.limit(0)):
        rows = sorted((r.doc_id, r.text or "") for r in table.collect())
        want = []
        for k, (key, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            n = len(text) // 4
            edited = text[: len(text) - n] + after[:n]
            a, b, c = merkle.tree(text), merkle.tree(edited), merkle.tree(after)
            want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a[0].hex(), b[0].hex(), merkle.likeness(a, b, len(text) + len(edited)), merkle.likeness(a, c, len(text) + len(after))))
        got = sorted(tuple(r) for r in merkle.compare_with_next(table).collect())
        assert got == sorted(want)
        assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)


def test_merkle_locates_edits(spark):
    a, b = merkle.tree("one\ntwo\n\nthree\nfour"), merkle.tree("one\ntwo\n\nthree\nFOUR")
    left, right = merkle.differing(a, b)
    assert len(left) == len(right) == 1 and a[1][0][0] == b[1][0][0]
    found = merkle.fingerprints(make(spark, ["x\ny", "x\ny", None])).collect()
    assert found[0].fingerprint == found[1].fingerprint != found[2].fingerprint


# --- 9


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, docs, awkward, keep):
    for table in (docs, awkward, awkward.limit(0)):
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        groups = defaultdict(list)
        for key, text in rows:
            groups[text].append(key)
        pick = min if keep == "smallest" else max
        want = sorted((k, pick(groups[t]), len(groups[t]), k == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
        assert sorted(tuple(r) for r in exact_dedup.exact_groups(table, keep=keep).collect()) == want
        left = exact_dedup.drop_exact_copies(table, keep=keep)
        assert left.columns == table.columns
        assert {r.doc_id for r in left.collect()} == {pick(g) for g in groups.values()}


# --- 10


def test_language_of_held_out_texts(spark, docs, awkward):
    held = queries.id_bucket("doc_id", 3) == 1
    model = language_id.learn(docs.where(~held))
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    rows = docs.where(held).collect()
    assert sum(found[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    for r in language_id.identify(awkward, model).collect():
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in AWKWARD[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(awkward, empty).collect()} == {"und"}
    assert language_id.drop_unknown_language(awkward.withColumn("lang", F.lit(None).cast("string"))).count() == awkward.count()
    left = language_id.drop_unknown_language(docs)
    assert left.columns == docs.columns


def test_more_languages_than_one_mask_holds(spark):
    rows = [(f"l{k:03d}", chr(0x4E00 + 40 * k) * 3 + chr(0x4E01 + 40 * k) * 3) for k in range(80)]
    table = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    model = language_id.learn(table)
    assert model.languages == [r[0] for r in rows]
    got = language_id.identify(table, model).join(table, "doc_id").where("lang = lang_pred").count()
    assert got == 80


def test_orders_of_hashes_have_no_fixed_first():
    """Two sets that share one hash of many meet by chance only, whatever hash that is."""
    for shared in (0, 1 << 63):
        x, y = (np.append(np.random.default_rng(k).integers(0, 1 << 64, 200, np.uint64), np.uint64(shared)) for k in (1, 2))
        assert not set(near_dedup.keys_of(x)) & set(near_dedup.keys_of(y))


def test_a_bucket_holds_few_copies_of_its_pairs():
    """About eight columns of eight bytes at once (103 bytes a pair before)."""
    import tracemalloc

    rng = np.random.default_rng(3)
    blocks = [b for _ in range(4) for _, b in language_model.pack([rng.integers(3, 1 << 62, 50_000, np.uint64)], [True], np.array([language_model.START]), 1)]
    tracemalloc.start()
    language_model.count_pairs(blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * 200_004
