"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, factors, fingerprints, language, packing, quality, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator over its whole table."""
    return {
        "op1_suffix_array_dedup": substrings.op1_suffix_array_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
        "op6_language_id": language.op6_language_id,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_substring_dedup": factors.op8_substring_dedup,
        "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {
        "op1_suffix_array_dedup": substrings.OP1_SQL,
        "op3_chat_formatting": chat.OP3_SQL,
        "op8_substring_dedup": factors.OP8_SQL,
        "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    }
