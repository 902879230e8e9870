"""The operators' queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, oracles, substring_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
