"""The registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    bpe,
    chat,
    exact_dedup,
    fill_in_middle,
    language_id,
    language_model,
    manifest,
    merkle,
    mixing,
    sentencepiece_bpe,
    sharding,
    simhash,
    substring_dedup,
)
from granary.llm.common import documents, id_bucket


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are; every executor has the package."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    both = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_model.score(docs, id_bucket("doc_id", 7) != 2)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(*chat.prefix_tree(turns.unionByName(extra))).withColumnRenamed("conv", "conv_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), width=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return substring_dedup.repeated_spans(documents(spark, sf_dir), 35).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


#: Share of all tokens each domain is to have.
MIX_TARGETS = {"high": 0.6, "low": 0.38, "toxic": 0.02}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").alias("label_id"), domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), labelled_domains(spark, sf_dir), MIX_TARGETS)
    return mixed.select("doc_id", "n_words", *(F.col("posterior")[d].alias(f"p_{d}") for d in sorted(MIX_TARGETS)), "rate")


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_bucket("doc_id", 3) == 1
    model = language_id.learn(docs.where(~held_out))
    predict = language_id.predictor(spark, model)
    found = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("piece_bpe_32k.model")
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest.verify(
        documents(spark, sf_dir),
        ["doc_id", "source", "lang", "n_chars", "text"],
        group_col="source",
        id_col="doc_id",
        tampered={"text": manifest.ascii_lower(F.col("text"))},
        where=fifth,
    )
    proof = F.sha2(manifest.siblings(F.col("path")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(documents(spark, sf_dir))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_lm_scoring,
        op3_chat,
        op4_sharding,
        op5_simhash,
        op6_substring_dedup,
        op7_mixing,
        op8_merkle,
        op9_exact_dedup,
        op10_language_id,
        op11_sentencepiece,
        op12_manifest,
        op13_fill_in_middle,
    )
}

#: crc32 of the decimal id, unsigned: eight steps of the reflected polynomial per byte.
_CRC32 = """
    xor(4294967295, list_reduce(
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, step: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
        CAST(4294967295 AS BIGINT)))
"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: Equivalent DuckDB SQL.  The others have no SQL form (learned models, codecs,
#: connected components at scale) and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_manifest": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC32} % 5 = 0
                    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)
        ),
        below AS (
            SELECT 0 AS height, source, place, n, leaf AS hash FROM leaves
            UNION ALL
            SELECT height + 1, source, place // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
            FROM below WHERE n > 1 GROUP BY height, source, place // 16, n
        ),
        subroots AS MATERIALIZED (
            SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1
        ),
        upper AS (
            SELECT 0 AS height, place, n, hash FROM subroots
            UNION ALL
            SELECT height + 1, place // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
            FROM upper WHERE n > 1 GROUP BY height, place // 16, n
        ),
        runs AS MATERIALIZED (
            SELECT height, source, place // 16 AS run, list(hash ORDER BY place) AS hashes FROM below WHERE n > 1 GROUP BY height, source, place // 16
        ),
        upper_runs AS MATERIALIZED (
            SELECT height, place // 16 AS run, list(hash ORDER BY place) AS hashes FROM upper WHERE n > 1 GROUP BY height, place // 16
        ),
        walk AS (
            SELECT leaf AS own, source, n, place, place AS at, 0 AS height, false AS above, coalesce(changed, leaf) AS folded, '' AS proof FROM leaves
            UNION ALL
            (SELECT w.own, w.source, CASE WHEN u.source IS NULL THEN (w.n + 15) // 16 ELSE u.n END, w.place,
                    CASE WHEN u.source IS NULL THEN w.at // 16 ELSE u.place END,
                    CASE WHEN u.source IS NULL THEN w.height + 1 ELSE 0 END,
                    w.above OR u.source IS NOT NULL,
                    CASE WHEN u.source IS NULL THEN sha256(array_to_string(coalesce(r.hashes, t.hashes)[: w.at % 16], '') || w.folded
                        || array_to_string(coalesce(r.hashes, t.hashes)[w.at % 16 + 2 :], '')) ELSE w.folded END,
                    w.proof || CASE WHEN u.source IS NULL THEN array_to_string(coalesce(r.hashes, t.hashes)[: w.at % 16], '')
                        || array_to_string(coalesce(r.hashes, t.hashes)[w.at % 16 + 2 :], '') ELSE '' END
             FROM walk w
             LEFT JOIN runs r ON NOT w.above AND w.n > 1 AND r.height = w.height AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.at // 16
             LEFT JOIN upper_runs t ON w.above AND t.height = w.height AND t.run = w.at // 16
             LEFT JOIN (SELECT 'x' AS source, source AS tree, place, n FROM subroots) u ON NOT w.above AND w.n = 1 AND u.tree IS NOT DISTINCT FROM w.source
             WHERE w.n > 1 OR NOT w.above)
        )
        SELECT l.doc_id, l.leaf, s.hash AS subroot, o.hash AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = o.hash AS verified
        FROM walk w
        JOIN leaves l ON l.source IS NOT DISTINCT FROM w.source AND l.place = w.place
        JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source
        CROSS JOIN (SELECT hash FROM upper WHERE n = 1) o
        WHERE w.above AND w.n = 1
    """,
    "op13_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, text, units, len(units) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN range(4)] AS h
            FROM (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents)
        ),
        cut AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                     WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        parts AS (
            SELECT *, array_to_string(units[: a], '') AS p, array_to_string(units[a + 1 : b], '') AS m, array_to_string(units[b + 1 :], '') AS s FROM cut
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
