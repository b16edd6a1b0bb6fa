"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediacat.llm import curriculum, decontaminate, divergence, hard_negatives, importance, language, pieces, pii, secrets, simhash, suffix_dedup, token_files, va_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25": decontaminate.query,
    "op2_token_efficiency": secrets.query,
    "op3_weak_supervision": pii.query,
    "op4_importance": importance.query,
    "op5_curriculum": curriculum.query,
    "op6_va_file": va_file.query,
    "op7_simple8b": token_files.query,
    "op8_column_bwt": suffix_dedup.query,
    "op9_simhash": simhash.query,
    "op10_language": language.query,
    "op11_count_bitmaps": divergence.query,
    "op12_gnat": hard_negatives.query,
    "op13_merge_rounds": pieces.query,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_curriculum": curriculum.ORACLE_SQL,
    "op6_va_file": va_file.ORACLE_SQL,
    "op11_count_bitmaps": divergence.ORACLE_SQL,
    "op12_gnat": hard_negatives.ORACLE_SQL,
}
