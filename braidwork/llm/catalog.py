"""The llm queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import bpe, decontamination, exact_dedup, fill_in_middle, filter_audit, language, language_model, mixing, quality, sharding, simhash, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_language": language.op2_language,
    "op3_language_model": language_model.op3_language_model,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_bpe": bpe.op12_bpe,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
