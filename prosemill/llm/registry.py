"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import exact_dedup, language_id, license_scan, mixing, near_dedup, piece_codec, quality, suffix_dedup, url_filter, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_piece_codec": piece_codec.op8_piece_codec,
    "op9_language_id": language_id.op9_language_id,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op2_vector_dedup": vector_dedup.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
