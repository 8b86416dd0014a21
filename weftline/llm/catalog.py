"""The queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.layout import spread
from weftline.llm import fingerprints, language_model, near_vectors, ngram_join, oracles, packing, quality, secrets, token_counts, trie_bpe, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict:
    return {
        "op1_token_counts": lambda spark, d: token_counts.count_tokens(_read(spark, d, "documents")),
        "op2_embedding_near_dedup": lambda spark, d: near_vectors.near(_read(spark, d, "embeddings")),
        "op3_url_filters": lambda spark, d: url_filter.filter_urls(_read(spark, d, "pages")),
        "op4_secret_scans": lambda spark, d: secrets.digest(_read(spark, d, "documents")),
        "op5_bpe_trie": lambda spark, d: trie_bpe.encode_digest(_read(spark, d, "documents")),
        "op6_quality_classifier": lambda spark, d: quality.classify(_read(spark, d, "documents"), _read(spark, d, "labels")),
        "op7_ngram_jaccard_join": lambda spark, d: ngram_join.similar(_read(spark, d, "documents")),
        "op8_best_fit_packing": lambda spark, d: packing.pack(_read(spark, d, "documents")),
        "op9_lm_scoring": lambda spark, d: language_model.score(_read(spark, d, "documents")),
        "op10_document_fingerprints": lambda spark, d: fingerprints.fingerprint_edits(_read(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
