"""The operators' queries over the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, fill_middle, filter_audit, licenses, line_dedup, mixing, near_dedup, packing, quality, secrets, substring_dedup, tokens

MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_license_scans": licenses,
    "op3_secret_scan": secrets,
    "op4_substring_dedup": substring_dedup,
    "op5_near_dedup": near_dedup,
    "op6_token_counts": tokens,
    "op7_packing": packing,
    "op8_quality_rules": quality,
    "op9_exact_dedup": exact_dedup,
    "op10_mix_sources": mixing,
    "op11_filter_audit": filter_audit,
    "op12_byte_bpe": byte_bpe,
    "op13_fill_in_middle": fill_middle,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)}
