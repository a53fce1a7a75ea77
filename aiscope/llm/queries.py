"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aiscope.llm import bytebpe, decontaminate, flatbpe, lengths, licenses, negatives, paragraphs, pitman_yor, quality, repair, secrets, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("rejected_by")  # which of several rules is named depends on the order


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(*repair.damage(table(spark, sf_dir, "conversations"))).drop("shape")


def op12_flat_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatbpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.mislabelled(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_paragraph_dedup": op3_paragraph_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_scores": op6_lm_scores,
    "op7_secret_scan": op7_secret_scan,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_flat_bpe": op12_flat_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Quality rules by counts of patterns; windows of five words are found by joining them.
_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest([array_to_string(ws[k : k + 4], ' ') for k in range(1, len(ws) - 3)]) AS x FROM w WHERE len(ws) >= 5),
 again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
 covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS o(k) GROUP BY r),
 b AS (SELECT d.doc_id, d.t, w.ls, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
   length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS calls
   FROM d JOIN w ON d.r = w.r LEFT JOIN covered c ON c.r = d.r),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 20 > word_chars OR word_chars < n_words * 2 OR word_chars > n_words * 25
  OR (n_dup_lines > 0 AND len(ls) >= 3 AND n_dup_lines * 10 > len(ls) * 3) OR letters * 2 < word_chars OR (letters >= 40 AND upper * 2 > letters) OR calls * 5 > n_words
  OR (len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) * 2 > len(ls))
  OR (len(ls) >= 5 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) * 10 > len(ls) * 9)) AS kept FROM f"""

#: Scores of all anchors and rows; windows as stated.
_OP13 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r AS a, r AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5"""

ORACLES: dict[str, str] = {"op2_quality_rules": _OP2, "op13_hard_negatives": _OP13}
