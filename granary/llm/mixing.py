"""Mixing to target token totals with soft domain membership.

A labelled table names the domain of some documents.  A naive Bayes classifier
over the presence of words (hashed), fitted on at most ``SAMPLE`` labelled rows,
predicts every document's domain posteriors.  Document rates r >= 0 then minimise
the weighted squares of (expected domain token totals - targets), where a document gives
r * words * posterior to each domain: projected gradient steps from r = 1, each
one aggregation of a few sums over all documents.  The weight is the inverse of
the domains' Gram matrix (domains x domains, on the driver): a step of length one
then never overshoots, and solves the problem where it hits no bound.  Momentum,
dropped whenever the squares grow, speeds up the rest.

DataFrame functions only.  Null text counts as empty; a text without words has
no part in any total and gets even posteriors and rate 1.  An empty table gives
no rows; without any usable label all posteriors are even.  Different texts
of one id are different documents with a rate each; a repeated row counts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WORD_GAP, checkpoint, fresh, text_name

#: Labelled rows that the classifier is fitted on, at most (those of lowest id hash).
SAMPLE = 20_000
#: Hashed word features; the weight table has this many rows at most.
BUCKETS = 1 << 20
#: Texts added to each side of a word's odds, so that rare words say little.
SHRINK = 3.0
#: Every word's log odds are drawn towards nothing by so many of their standard errors; so all words of
#: the sample enter, and one that chance explains says nothing.
DOUBT = 4.0
#: Share of the texts above which the absence of a word says nothing.
COMMON = 0.05
#: A target: what a domain's classifier sees of it in documents that more likely belong to others; so only its own documents go.
LEFTOVER = "leftover"
STEPS = 32
TOLERANCE = 1e-4


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct word of ``body`` with ``n_words``, the number of all words; ``bucket`` is null for none."""
    words = F.filter(F.split(F.lower("body"), WORD_GAP, -1), lambda w: w != "")
    return (
        docs.select(*keep, words.alias("words"))
        .select(*keep, F.size("words").alias("n_words"), F.explode_outer(F.array_distinct("words")).alias("word"))
        .select(*keep, "n_words", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("word").isNotNull().alias("some"))
        .select(*keep, "n_words", F.when(F.col("some"), F.col("bucket")).alias("bucket"))
    )


def fit_weights(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(``bucket``, ``weights`` array by domain) of the telling words, and the log odds of a text with none.

    ``docs`` has ``id`` and ``body``; ``labelled`` has ``label_id`` and
    ``domain``.  Ids with several labels count under each; equal texts count
    once in a domain.
    """
    sample = (
        labelled.where(F.col("domain").isin(domains) & F.col("label_id").isNotNull())
        .orderBy(F.xxhash64("label_id"), "label_id", "domain")
        .limit(SAMPLE)
    )
    known = docs.join(F.broadcast(sample), docs["id"] == sample["label_id"]).select("domain", "body", F.md5("body").alias("text_hash"))
    texts = known.dropDuplicates(["domain", "text_hash"])
    counts = checkpoint(
        words_of(texts, "domain", "text_hash").select("domain", "text_hash", "bucket").distinct()
        .groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = {r[0]: r[1] for r in texts.groupBy("domain").count().collect()}  # one row per domain
    everyone = sum(rows.values())
    share = {d: rows.get(d, 0) / max(everyone, 1) for d in domains}
    wide = counts.where("bucket is not null").groupBy("bucket").agg(
        F.sum("n").alias("all"), *(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains))
    )
    expected = {d: F.col("all") * share[d] for d in domains}
    # Share of a domain's texts with the word, drawn to the share of all texts.
    overall = (F.col("all") + 1) / F.lit(everyone + 2.0)
    inside = []
    for k, d in enumerate(domains):
        pull = SHRINK * share[d] + 1e-9
        odds = F.log((F.col(f"n{k}") + pull) / (expected[d] + pull))
        doubt = DOUBT * F.sqrt(F.lit(1.0 - share[d]) / (F.col(f"n{k}") + pull))
        inside.append(F.least(F.lit(0.999), overall * F.exp(F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - doubt))))
    telling = F.lit(False)
    for p in inside:
        telling = telling | (p != overall)
    # The absence of a common word mostly tells how long a text is, so it does not count.
    absent = [F.when(overall <= COMMON, F.log((1 - p) / (1 - overall))).otherwise(0.0) for p in inside]
    table = checkpoint(
        wide.where(telling).select(
            "bucket", F.array(*absent).alias("absent"), F.array(*(F.log(p / overall) - x for p, x in zip(inside, absent, strict=True))).alias("weights")
        )
    )
    bare = table.agg(*(F.sum(F.col("absent")[k]) for k in range(len(domains)))).first()  # a text with no telling word
    priors = [float(np.log((rows.get(d, 0) + 1) / (everyone + len(domains)))) + (bare[k] or 0.0) for k, d in enumerate(domains)]
    return table.select("bucket", "weights"), priors


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``id``, ``name``, ``n_words`` and ``p0``, ``p1``, ... by domain, one row per id and text of ``docs`` (``id``, ``body``)."""
    weights, priors = fit_weights(docs, labelled, domains)
    found = (
        words_of(docs.withColumn("name", text_name("body")), "id", "name")
        .join(F.broadcast(weights), "bucket", "left")  # BUCKETS rows at most
        .groupBy("id", "name")
        .agg(
            F.max("n_words").alias("n_words"),
            *(F.sum(F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(f"s{k}") for k in range(len(domains))),
        )
    )
    logits = [F.col(f"s{k}") + F.lit(prior) for k, prior in enumerate(priors)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp(x - top) for x in logits]
    whole = sum(parts[1:], parts[0])
    return found.select("id", "name", "n_words", *((p / whole).alias(f"p{k}") for k, p in enumerate(parts)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``name`` (of the text), ``n_words``, ``posterior`` (map by domain) and ``rate`` of every id and text.

    ``labelled`` has ``label_id`` and ``domain``; ``targets`` gives each domain's
    expected token total as a share of all tokens (the shares need not sum to 1).
    """
    domains = sorted(targets)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    ps = [f"p{k}" for k in range(len(domains))]
    state = checkpoint(posteriors(rows, labelled, domains).withColumn("rate", F.lit(1.0)))
    pairs = [(a, b) for a in ps for b in ps]
    found = state.agg(F.sum("n_words"), *(F.sum(F.col("n_words") * F.col(p)) for p in ps), *(F.sum(F.when(F.col(p) < 0.5, F.col("n_words") * F.col(p))) for p in ps), *(F.sum(F.col("n_words") * F.col(a) * F.col(b)) for a, b in pairs)).first()
    tokens = float(found[0] or 1)
    natural = [(x or 0.0) / tokens for x in found[1 : len(ps) + 1]]
    leftover = [(x or 0.0) / tokens for x in found[len(ps) + 1 : 2 * len(ps) + 1]]
    gram = np.array([x or 0.0 for x in found[2 * len(ps) + 1 :]], float).reshape(len(ps), len(ps)) / tokens
    weight = np.linalg.pinv(gram, rcond=1e-3, hermitian=True)
    wanted = np.array([{None: own, LEFTOVER: rest}.get(targets[d], targets[d]) for d, own, rest in zip(domains, natural, leftover, strict=True)], float)
    state = state.withColumn("before", F.col("rate"))
    last, speed, least = None, 1.0, float("inf")
    for step in range(STEPS):
        found = state.agg(*(F.sum(F.col("n_words") * F.col("rate") * F.col(p)) for p in ps)).first()
        sums = np.array([x or 0.0 for x in found]) / tokens
        error = sums - wanted
        loss = float(error @ weight @ error)
        if np.abs(error).max() < TOLERANCE or abs(least - loss) < TOLERANCE**2:
            break
        following = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        push = 0.0 if last is None or loss > least else (speed - 1) / following
        speed, least = (1.0 if loss > least else following), loss
        ahead = error if last is None else error + push * (sums - last)
        slope = weight @ ahead
        move = sum((F.col(p) * float(x) for p, x in zip(ps[1:], slope[1:], strict=True)), F.col(ps[0]) * float(slope[0]))
        pushed = F.col("rate") + push * (F.col("rate") - F.col("before")) - move
        state = state.select("id", "name", "n_words", *ps, F.greatest(F.lit(0.0), pushed).alias("rate"), F.col("rate").alias("before"))
        last = sums
        if step % 4 == 3:
            state = checkpoint(state)
    named = F.create_map(*(x for d, p in zip(domains, ps, strict=True) for x in (F.lit(d), F.col(p))))
    return state.select(F.col("id").alias(id_col), "name", F.col("n_words").cast("long").alias("n_words"), named.alias("posterior"), "rate")


def resample(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate, rounded to the nearest whole number (halves up).

    Rates belong to an id and a text.  A row without a rate, or with a null id, stays once.
    """
    times, turn = fresh(docs, "times"), fresh(docs, "turn")
    known = rates.select(F.col(id_col).alias("rate_id"), F.col("name").alias("rate_name"), F.floor(F.col("rate") + 0.5).cast("int").alias("rounded"))
    out = docs.join(known, (docs[id_col] == known["rate_id"]) & (text_name(docs[text_col]) == known["rate_name"]), "left")
    counted = out.select(*(docs[c] for c in docs.columns), F.coalesce(known["rounded"], F.lit(1)).alias(times)).where(F.col(times) > 0)
    return counted.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, turn)
