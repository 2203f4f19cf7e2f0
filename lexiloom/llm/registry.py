"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, lang_id, license_scan, mixing, near_dedup, pii, suffix_dedup, toxicity

_OPERATORS = {
    "op1_chat_format": chat_format,
    "op2_decontaminate": decontaminate,
    "op3_suffix_dedup": suffix_dedup,
    "op4_mixing": mixing,
    "op5_language_id": lang_id,
    "op6_exact_dedup": exact_dedup,
    "op7_near_dedup": near_dedup,
    "op8_pii": pii,
    "op9_toxicity": toxicity,
    "op10_license_scan": license_scan,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _OPERATORS.items() if hasattr(m, "SQL")}


def nullable_sql() -> dict[str, str]:
    """SQL of the queries whose results hold null numbers, which pandas shows as floats on one side only: compare values, not their text."""
    return {name: m.NULLABLE_SQL for name, m in _OPERATORS.items() if hasattr(m, "NULLABLE_SQL")}
