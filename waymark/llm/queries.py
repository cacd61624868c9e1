"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    divergence,
    exact_dedup,
    language_id,
    lexical_search,
    near_dup,
    packing,
    pii,
    quality_rules,
    sentencepiece_dropout,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)
from .common import documents, held_out, labels


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, labels(spark, sf_dir), lambda doc_id: ~held_out(doc_id))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    edits = token_counts.derived_edits(F.col("doc_id"), F.col("text"))
    told = docs.select("doc_id", token_counts.counts_after_edits(F.col("text"), edits, path, pattern).alias("told"))
    names = ("tokens_before", "tokens_after", "pretokens", "recounted")
    return told.select("doc_id", *(F.col(f"told.{x}").alias(x) for x in names), F.sha2(F.col("told.edited"), 256).alias("edited_sha256"))


def op4_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(documents(spark, sf_dir)).withColumnRenamed("ref_id", "ref_doc_id")


def op10_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = quality_rules.quality_decisions(documents(spark, sf_dir), labels(spark, sf_dir))
    return decided.select(
        F.col("id").alias("doc_id"),
        *(F.col(f"q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        F.col("q_kept").alias("kept"),
        F.col("q_rule").alias("rule"),
    )


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op5_swap_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.learn_profiles(docs.filter(~held_out(F.col("doc_id"))).select(F.col("lang").alias("label"), "text"))
    told = language_id.predict_language(docs, profiles)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir)
    encoded = docs.select("doc_id", "text", sentencepiece_dropout.encode_with_dropout(F.col("text"), F.col("doc_id"), path).alias("ids"))
    return encoded.withColumn("decoded", sentencepiece_dropout.decode_ids(F.col("ids"), path)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op8_coordinate_join_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dedup(documents(spark, sf_dir), k=4)


def op11_digest_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op12_bag_dedup_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


QUERIES = (
    op1_weak_supervision_pii,
    op2_noisy_channel_toxicity,
    op3_edit_aware_token_counts,
    op4_heavy_hitter_dedup,
    op5_swap_search_packing,
    op6_rank_order_language,
    op7_merge_dropout_pieces,
    op8_coordinate_join_near_dedup,
    op9_collinear_passages,
    op10_decision_list_quality,
    op11_digest_source_divergence,
    op12_bag_dedup_search,
    op13_deletion_variant_simhash,
)

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
gc AS (SELECT lang, source, term, sum(c.n) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(gc.n, 0) AS n,
    CAST(1 + (1000000000 * (CAST(coalesce(gc.n, 0) AS HUGEINT) + 2)) // (gt.total + 2 * v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (CAST(kept.n AS HUGEINT) + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN gt USING (lang, source) JOIN v USING (lang) LEFT JOIN gc USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms
) WHERE rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), l AS (SELECT count(*) AS docs, coalesce(sum(len(terms)), 0) AS total FROM d WHERE len(terms) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), l),
x AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS x FROM c JOIN w USING (term), l),
s AS (SELECT item_id, r, doc_id, CAST(sum(x) AS BIGINT) AS score FROM x JOIN i USING (term) GROUP BY ALL HAVING sum(x) > 0)
SELECT * FROM (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s
) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_heavy_hitter_dedup": OP4_SQL, "op11_digest_source_divergence": OP11_SQL, "op12_bag_dedup_search": OP12_SQL}
