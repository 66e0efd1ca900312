"""Registered queries of the llm operators: each applies its operator to its whole table."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import ship, table


def operator(name: str):
    return importlib.import_module(f"bindery.llm.{name}")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return operator("topk").top_k(vectors, 5, F.col("vec_id") % 50 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = operator("substrings").dedup_substrings(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return operator("tokens").count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    groups = operator("simhash").simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("licenses").scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, op = table(spark, sf_dir, "documents"), operator("quality")
    scored = op.score(docs, op.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",)), metadata=("n_chars",))
    return scored.select("doc_id", op.held_out().alias("held_out"), "score", op.predicted().alias("predicted"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return operator("html").extract(table(spark, sf_dir, "pages"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("syncmers").compared_with_next(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return operator("pieces").coded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator("mixing").mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_substring_dedup, op3_token_counts, op4_simhash_near_dedup, op5_license_scan, op6_quality_classifier, op7_html_extraction, op8_document_fingerprints, op9_sentencepiece, op10_mixing)}

ORACLES = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""",
}
