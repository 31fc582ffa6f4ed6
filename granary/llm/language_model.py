"""Katz back-off bigram model over words, learned and applied in one Spark plan.

Tokens are words (A-Z lower-cased) and one end per text.  P(v | u) is the
Good-Turing discounted share of u's occurrences that v follows, where the pair
was seen in training, however rarely, and otherwise alpha(u) * P(v); alpha(u) makes
the sum over all v exactly one.  P(v) is the discounted share of all tokens, and
one unknown token has exactly the mass that the discounts leave.

Each task packs the pairs of some thousand texts, sorted and counted, into one
block per bucket of first words.  The blocks are shuffled once and read by several
branches of one plan: to count words and pairs, to ask for P(v) where a pair was
not seen, and to add up each text's terms.  Two tables are joined by word: of the
seen pairs, whose P(v) make alpha(u), and of the questions.  P(v) of frequent words
(``FREQUENT`` at most, found in a share of the texts, counted in all) is broadcast;
only the pairs that end in another word travel.  A bucket is a partition or, by
``SPLIT``, a fraction of one, so what one group of the Python side holds does not
grow with the input where the partitions do; more buckets make more partial sums.

Words that are common in a share of the texts of all partitions have their pairs
spread over all buckets; that moves work and changes no figure.

Null text counts as empty: one token, the end.  A null training flag means held
out.  Where the counts of counts are too thin for a Good-Turing discount between
0 and 1, a count r keeps (r - 1/2) / r.  With nothing to learn from, every token
is the unknown one and scores 0.  Ids may be of any type, null or repeated.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import checkpoint, partitions, slices

#: Counts up to this are discounted.
TOP_DISCOUNT = 5
#: Share of the texts that are looked at for words whose pairs should be spread, and for frequent ones.
PROBE = 0.05
FREQUENT = 1 << 19
#: Buckets in a partition.
SPLIT = 1
#: Words and texts packed into one set of blocks.
BLOCK_WORDS = 1 << 21
BLOCK_TEXTS = 50_000
START, END = np.uint64(1), np.uint64(2)
_U = np.uint64


def names_of(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack(texts: list[np.ndarray], trained: list[bool], spread: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(partition, block) of some texts; a block holds words, followers, texts and counts, sorted."""
    sizes = np.array([len(t) + 1 for t in texts])
    u = np.concatenate([np.append(START, t) for t in texts])
    v = np.concatenate([np.append(t, END) for t in texts])
    d = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)
    of_u, of_v = mix(u), mix(v + _U(0x9E3779B97F4A7C15))
    low = _U((1 << 24) - 1)
    key = (np.where(np.isin(u, spread), mix(of_u ^ of_v), of_u) % _U(buckets)) << _U(48)
    key |= (of_u & low) << _U(24)
    key |= of_v & low
    del of_u, of_v
    order = np.argsort(key, kind="stable")
    place, u, v, d = (key >> _U(48))[order], u[order], v[order], d[order]
    del key, order
    flags = np.packbits(np.array(trained, bool))
    cuts = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        x, y, z = u[cuts[b] : cuts[b + 1]], v[cuts[b] : cuts[b + 1]], d[cuts[b] : cuts[b + 1]]
        if not len(x):
            continue
        new_u = np.append(True, x[1:] != x[:-1])
        new_pair = new_u | np.append(True, y[1:] != y[:-1])
        new_entry = new_pair | np.append(True, z[1:] != z[:-1])
        entries, pairs = np.flatnonzero(new_entry), np.flatnonzero(new_pair)
        yield b, pickle.dumps(
            (
                x[new_u],
                small(np.diff(np.append(np.flatnonzero(new_u[pairs]), len(pairs)))),
                y[pairs],
                small(np.diff(np.append(np.flatnonzero(new_pair[entries]), len(entries)))),
                z[entries],
                small(np.diff(np.append(entries, len(x)))),
                flags,
                len(texts),
            ),
            protocol=5,
        )


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """Per pair: word, follower; per entry: its pair, text and count; then the texts' flags."""
    u, followers, v, entries, d, count, flags, n = pickle.loads(block)
    pair_of = np.repeat(np.arange(len(v)), entries)
    return np.repeat(u, followers), v, pair_of, d.astype(np.int64), count.astype(np.int64), np.unpackbits(flags, count=n).astype(np.int64)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A sort key by which equal pairs, and pairs of one first word, stand together."""
    high = _U(0xFFFFFFFF00000000)
    return (mix(u) & high) | (mix(v + _U(0x9E3779B97F4A7C15)) >> _U(32))


def count_pairs(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, follower) of a bucket and their counts in training texts, by ``pair_key``."""
    us, vs, cs = [], [], []
    for block in blocks:
        u, v, pair_of, d, count, trained = unpack(block)
        c = np.bincount(pair_of, weights=count * trained[d], minlength=len(u)).astype(np.int64)
        us.append(u[c > 0])
        vs.append(v[c > 0])
        cs.append(c[c > 0].astype(np.int32))  # of one block, which is bounded
    # One column after the other, so that few copies of a bucket are held at once.
    u = np.concatenate(us)
    us.clear()
    v = np.concatenate(vs)
    vs.clear()
    c = np.concatenate(cs)
    cs.clear()
    key = pair_key(u, v)
    order = np.argsort(key)
    u = u[order]
    v = v[order]
    c = c[order]
    key = key[order]
    del order
    differs = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    if (differs & (key[1:] == key[:-1])).any():  # different pairs of one key: order them by their words as well
        order = np.lexsort((v, u, key))
        u, v, c = u[order], v[order], c[order]
        differs = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    del key
    at = np.flatnonzero(np.append(True, differs)) if len(u) else np.zeros(0, np.int64)
    return u[at], v[at], np.add.reduceat(c, at, dtype=np.int64) if len(at) else c.astype(np.int64)


def discounts(n: list[Column]) -> Column:
    """Array of the discounts of counts 1 to TOP_DISCOUNT; ``n``: how many have count 1, 2, ..."""
    k = TOP_DISCOUNT
    a = F.try_divide((k + 1) * n[k], n[0])
    out = []
    for r in range(1, k + 1):
        d = F.try_divide(F.try_divide((r + 1) * n[r], r * n[r - 1]) - a, 1 - a)
        out.append(F.when((a < 1) & (d > 0) & (d <= 1), d).otherwise(F.lit((r - 0.5) / r)))
    return F.array(*out)


def discounted(count: Column, table: Column) -> Column:
    return F.when(count <= TOP_DISCOUNT, F.element_at(table, F.least(count, F.lit(TOP_DISCOUNT)).cast("int")) * count).otherwise(count.cast("double"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``name`` and ``c`` of the words of ``body``, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            names, times = np.unique(np.concatenate([names_of(t.as_py()) for t in b.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times.astype(np.int64))], ["name", "c"])

    return rows.select("body").mapInArrow(run, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``train`` holds and score all rows.

    Returns id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score`` (this model), both log10.
    """
    spark = docs.sparkSession
    n, buckets = partitions(spark), partitions(spark) * SPLIT
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)

    some = checkpoint(word_counts(rows.sample(PROBE, 2)).orderBy(F.desc("c"), "name").limit(FREQUENT))
    probed = some.agg(F.sum("c")).first()[0] or 0
    common = some.where(F.col("c") * (4 * buckets) >= max(probed, 1)).collect()  # 4 x buckets names at most
    spread = np.append(np.array([r[0] for r in common], np.int64).view(np.uint64), START)
    spread_names = spark.createDataFrame([(int(x),) for x in spread.view(np.int64)], "u long")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, texts, trained, words = [], [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            batch = (part << 24) + made
            for k, (b, block) in enumerate(pack(texts, trained, spread, buckets)):
                first = k == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()),
                        pa.array([batch], pa.int64()),
                        pa.array([block], pa.binary()),
                        pa.array([ids if first else None], pa.list_(id_type)),
                        pa.array([trained if first else None], pa.list_(pa.bool_())),
                        pa.array([[len(t) + 1 for t in texts] if first else None], pa.list_(pa.int64())),
                        pa.array([len(texts)], pa.int32()),
                    ],
                    ["bucket", "batch", "block", "ids", "trained", "sizes", "n_texts"],
                )

        for b in batches:
            for key, text, flag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                names = names_of(text.as_py())
                ids.append(key)
                texts.append(names)
                trained.append(flag)
                words += len(names)
                if words >= BLOCK_WORDS or len(texts) >= BLOCK_TEXTS:
                    yield from emit()
                    made += 1
                    ids, texts, trained, words = [], [], [], 0
        if texts:
            yield from emit()

    dealt = rows.mapInArrow(
        blocks_of, f"bucket int, batch long, block binary, ids array<{kind}>, trained array<boolean>, sizes array<long>, n_texts int"
    ).repartition(n, "bucket")
    # All columns of the blocks go into every group, so that all branches read the same shuffle.
    grouped = dealt.groupBy("bucket")
    k = TOP_DISCOUNT

    def counts_of(table: pa.Table) -> pa.Table:
        """Kind 0: words and counts; 2: how many pairs have count r; 3: the same of each spread word, for r above k their sum."""
        u, v, c = count_pairs(table.column("block").to_pylist())
        new = np.ones(len(u), bool)
        new[1:] = u[1:] != u[:-1]
        at = np.flatnonzero(new)
        out = [
            (np.where(u[at] == START, END, u[at]), 0, np.zeros(len(at), np.int64), np.add.reduceat(c, at) if len(at) else c),
            (np.zeros(k + 1, np.uint64), 2, np.arange(1, k + 2), np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1:-1]),
        ]
        mine = np.isin(u, spread)
        for name in np.unique(u[mine]):
            own = c[mine][u[mine] == name]
            low = np.bincount(np.minimum(own, k + 1), minlength=k + 2)[1 : k + 1]
            out.append((np.full(k + 1, name), 3, np.arange(1, k + 2), np.append(low, own[own > k].sum())))
        return pa.table(
            {
                "name": np.concatenate([x[0] for x in out]).astype(np.uint64).view(np.int64),
                "kind": pa.array(np.concatenate([np.full(len(x[0]), x[1]) for x in out]), pa.int32()),
                "r": pa.array(np.concatenate([x[2] for x in out]), pa.int32()),
                "c": np.concatenate([x[3] for x in out]).astype(np.int64),
            }
        )

    # One exchange by name for all kinds, told apart only afterwards (r is 0 for kind 0 alone), so that the
    # blocks are counted once.
    counts = (
        grouped.applyInArrow(counts_of, "name long, kind int, r int, c long")
        .repartition(n, "name").groupBy("name", "r").agg(F.sum("c").alias("c"), F.max("kind").alias("kind"))
    )
    words = counts.where("kind = 0").select("name", "c")
    word_sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_all"),
        F.count(F.lit(1)).alias("n_distinct"),
        *(F.count_if(F.col("c") == r).alias(f"w{r}") for r in range(1, k + 2)),
    )
    pair_sums = counts.where("kind = 2").agg(
        *(F.coalesce(F.sum(F.when(F.col("r") == r, F.col("c"))), F.lit(0)).alias(f"b{r}") for r in range(1, k + 2))
    )
    left_over = sum((F.col(f"w{r}") * r * (1 - F.col("dw")[r - 1]) for r in range(1, k + 1)), F.lit(0.0))
    model = (
        word_sums.join(F.broadcast(pair_sums))  # one row each
        .withColumn("dw", discounts([F.col(f"w{r}") for r in range(1, k + 2)]))
        .withColumn("db", discounts([F.col(f"b{r}") for r in range(1, k + 2)]))
        .withColumn("left_over", left_over)
        .select(
            "n_all",
            "n_distinct",
            "dw",
            "db",
            # with no mass left over, the unknown token counts as one more token
            (F.col("n_all") + F.when(F.col("left_over") > 0, 0).otherwise(1)).cast("double").alias("whole"),
            F.when(F.col("left_over") > 0, F.col("left_over")).otherwise(F.lit(1.0)).alias("unknown"),
        )
    )
    shares = words.join(F.broadcast(model)).select("name", (discounted(F.col("c"), F.col("dw")) / F.col("whole")).alias("p_v"))
    frequent = shares.join(F.broadcast(some.select("name")), "name", "left_semi").select(F.col("name").alias("v"), F.col("p_v").alias("p_often"))

    def pairs_of(table: pa.Table) -> pa.Table:
        """Seen pairs; those of a spread word belong to bucket -1."""
        u, v, c = count_pairs(table.column("block").to_pylist())
        own = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array(np.where(np.isin(u, spread), -1, own), pa.int32()), "u": u.view(np.int64), "v": v.view(np.int64)})

    pairs = grouped.applyInArrow(pairs_of, "bucket int, u long, v long").where("u is not null")
    often = pairs.join(F.broadcast(frequent), "v", "left")  # FREQUENT rows at most
    # Both parts in one pass: what ends in a frequent word is summed before the shuffle, the rest asks for its word.
    known = often.groupBy("bucket", "u", F.when(F.col("p_often").isNull(), F.col("v")).alias("asks")).agg(F.sum("p_often").alias("below"))
    asked = known.where("asks is not null").join(shares, F.col("asks") == F.col("name")).select("bucket", "u", F.col("p_v").alias("below"))
    both = known.where("asks is null").select("bucket", "u", "below").unionByName(asked)
    below = both.repartition(n, "bucket").groupBy("bucket", "u").agg(F.sum("below").alias("below"))

    spread_below = below.where("bucket = -1").select("u", "below")
    of_count = F.when(F.col("r") > k, F.col("c").cast("double")).otherwise(F.col("c") * F.col("r") * F.element_at("db", F.least("r", F.lit(k))))
    spread_kept = counts.where("kind = 3").join(F.broadcast(model)).groupBy(F.col("name").alias("u")).agg(F.sum(of_count).alias("kept"))
    spread_counts = words.join(
        F.broadcast(spread_names.select(F.when(F.col("u") == int(START), int(END)).otherwise(F.col("u")).alias("name"), "u")), "name"
    )
    # 4 x buckets + 1 rows at most, in one row.
    spread_model = spread_counts.join(spread_kept, "u", "left").join(spread_below, "u", "left").agg(
        F.collect_list(F.struct("u", "c", F.coalesce("kept", F.lit(0.0)).alias("kept"), F.coalesce("below", F.lit(0.0)).alias("below"))).alias("spread")
    )

    def questions_of(table: pa.Table) -> pa.Table:
        """Words whose P(v) a text needs, as the pair before them was not seen: (name, batch, text, times)."""
        blocks = table.column("block").to_pylist()
        seen = Pairs(*count_pairs(blocks))
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch, block in zip(table.column("batch").to_pylist(), blocks, strict=True):
            u, v, pair_of, d, count, _ = unpack(block)
            new = (seen.find(u, v) < 0)[pair_of]
            out.append((v[pair_of[new]], np.full(new.sum(), batch), d[new], count[new]))
        name, batch, text, times = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"name": name.view(np.int64), "batch": batch, "text": pa.array(text, pa.int32()), "times": times})

    questions = grouped.applyInArrow(questions_of, "name long, batch long, text int, times long").where("name is not null")
    answered = (
        questions.join(shares, "name", "left")
        .join(F.broadcast(model.select("unknown", "whole")))
        .groupBy("batch", "text")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("p_v", F.col("unknown") / F.col("whole")))).alias("backed"))
    )

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _parts([], id_type)
        m = {c: left.column(c)[0].as_py() for c in ("n_all", "n_distinct", "db", "spread")}
        blocks = left.column("block").to_pylist()
        tables = Tables(blocks, right, m)
        out = []
        for k, block in enumerate(blocks):
            sums = tables.sums(block, left.column("n_texts")[k].as_py())
            row = {c: left.column(c)[k].as_py() for c in ("batch", "ids", "trained", "sizes")}
            if row["ids"] is not None:  # once for each text: its end
                sums = [s + e for s, e in zip(sums, tables.end, strict=True)]
            used = np.flatnonzero(sums[2] + sums[3])
            thin = 2 * len(used) < len(sums[0])
            data = [s[used] if thin else s for s in (sums[0], sums[1], small(sums[2].astype(np.int64)))]
            out.append(row | {"train_tokens": m["n_all"], "part": pickle.dumps((small(used) if thin else None, *data), protocol=5)})
        return _parts(out, id_type)

    parts = (
        dealt.join(F.broadcast(model.select("n_all", "n_distinct", "db")))
        .join(F.broadcast(spread_model))
        .groupBy("bucket")
        .cogroup(below.where("bucket >= 0").groupBy("bucket"))
        .applyInArrow(add_up, f"batch long, ids array<{kind}>, trained array<boolean>, sizes array<long>, train_tokens long, part binary")
    )

    def finish(table: pa.Table) -> pa.Table:
        holds = next(k for k in range(table.num_rows) if table.column("ids")[k].is_valid)
        ids = table.column("ids")[holds].as_py()
        sums = [np.zeros(len(ids)) for _ in range(3)]
        for part in table.column("part").to_pylist():
            used, *data = pickle.loads(part)
            for s, x in zip(sums, data, strict=True):
                if used is None:
                    s += x
                else:
                    s[used] += x
        return pa.table(
            {
                "batch": table.column("batch")[holds].as_py() + np.zeros(len(ids), np.int64),
                "text": np.arange(len(ids), dtype=np.int32),
                "id": pa.array(ids, id_type),
                "held_out": pa.array([not x for x in table.column("trained")[holds].as_py()], pa.bool_()),
                "n_tokens": pa.array(table.column("sizes")[holds].as_py(), pa.int64()),
                "n_known": pa.array(sums[2].astype(np.int64)),
                "train_tokens": pa.array([table.column("train_tokens")[holds].as_py()] * len(ids), pa.int64()),
                "base_score": sums[1],
                "score": sums[0],
            }
        )

    out = parts.groupBy("batch").applyInArrow(
        finish, f"batch long, text int, id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.join(answered, ["batch", "text"], "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score")
    )


def _parts(rows: list[dict], id_type: pa.DataType) -> pa.Table:
    schema = pa.schema(
        [
            ("batch", pa.int64()),
            ("ids", pa.list_(id_type)),
            ("trained", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int64())),
            ("train_tokens", pa.int64()),
            ("part", pa.binary()),
        ]
    )
    return pa.Table.from_pylist(rows, schema=schema)


class Pairs:
    """Pairs in the order of ``count_pairs``, to be found by their words."""

    def __init__(self, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        self.u, self.v, self.c, self.key = u, v, c, pair_key(u, v)

    def find(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Place of each pair, -1 for one that is not there."""
        if not len(self.key):
            return np.full(len(u), -1)
        key = pair_key(u, v)
        k = np.searchsorted(self.key, key)
        found = np.full(len(u), -1)
        open_ = np.arange(len(u))
        while len(open_):  # more than one step only where pairs share a key
            open_ = open_[k[open_] < len(self.key)]
            open_ = open_[self.key[k[open_]] == key[open_]]
            hit = (self.u[k[open_]] == u[open_]) & (self.v[k[open_]] == v[open_])
            found[open_[hit]] = k[open_[hit]]
            open_ = open_[~hit]
            k[open_] += 1
        return found


class Tables:
    """One bucket's words and pairs, ready to add up the terms of a block.

    A seen pair has its discounted share, another one alpha of its first word;
    P(v) of the latter comes from the questions.
    """

    def __init__(self, blocks: list[bytes], below_of: pa.Table, m: dict) -> None:
        us, cs = [], []
        for block in blocks:
            u, _, pair_of, d, count, trained = unpack(block)
            c = np.bincount(pair_of, weights=count * trained[d], minlength=len(u))
            runs = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
            us.append(u[runs])  # a word's pairs stand together, so this is a row a word
            cs.append(np.add.reduceat(c, runs) if len(runs) else c)
        self.words, at = np.unique(np.concatenate(us), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(cs), minlength=len(self.words)).astype(float)
        self.pairs = Pairs(*count_pairs(blocks))
        u, c = self.pairs.u, self.pairs.c
        table = np.append(0.0, m["db"])
        left_count = np.where(c <= TOP_DISCOUNT, table[np.minimum(c, TOP_DISCOUNT)] * c, c).astype(float)
        of = np.searchsorted(self.words, u)
        kept = np.bincount(of, weights=left_count, minlength=len(self.words)).astype(float)
        below = np.zeros(len(self.words))
        if below_of.num_rows:
            below[np.searchsorted(self.words, below_of.column("u").to_numpy().view(np.uint64))] = below_of.column("below").to_numpy()
        spread = {e["u"] & (1 << 64) - 1: e for e in m["spread"]}
        ends = spread.get(int(START))
        for name, e in spread.items():
            k = int(np.searchsorted(self.words, _U(name)))
            if k < len(self.words) and self.words[k] == _U(name):
                counts[k], kept[k], below[k] = e["c"], e["kept"], e["below"]
        # where nothing is left for other followers, one more occurrence is set aside for them
        history = np.maximum(counts, 1.0)
        history = np.where(kept > history - 1e-9, history + 1, history)
        self.alpha = np.log10((1 - kept / history) / (1 - below))
        self.seen = np.log10(left_count / history[of]) if len(of) else left_count
        whole = math.log10(m["n_all"] + m["n_distinct"] + 1)
        self.base_term = np.log10(counts + 1) - whole
        self.known = (counts > 0).astype(float)
        at_start = np.flatnonzero(self.words == START)  # the start is no token
        self.base_term[at_start] = self.known[at_start] = 0
        c_end = float(ends["c"]) if ends else 0.0
        self.end = [0.0, math.log10(c_end + 1) - whole, float(c_end > 0), 0.0]

    def sums(self, block: bytes, n_texts: int) -> list[np.ndarray]:
        """Per text: score without the P(v) of unseen pairs, base score, known tokens, entries."""
        u, v, pair_of, d, count, _ = unpack(block)
        at = np.searchsorted(self.words, u)
        place = self.pairs.find(u, v)
        per_pair = self.alpha[at].copy()
        per_pair[place >= 0] = self.seen[place[place >= 0]]
        at = at[pair_of]
        terms = (per_pair[pair_of], self.base_term[at], self.known[at], np.ones(len(at)))
        return [np.bincount(d, weights=t * count, minlength=n_texts) for t in terms]
