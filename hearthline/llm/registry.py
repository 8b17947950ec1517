"""The operators' queries and SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import (
    decontamination, extraction, filter_audit, language, line_templates, mixing, near_duplicates, neighbours, quality, repeated_passages, sharding, token_store, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_mixing": mixing.query,
    "op11_whitening": whitening.query,
    "op12_language": language.query,
    "op13_filter_audit": filter_audit.query,
    "op1_near_duplicates": near_duplicates.query,
    "op2_sharding": sharding.query,
    "op3_extraction": extraction.query,
    "op4_repeated_passages": repeated_passages.query,
    "op5_quality": quality.query,
    "op6_decontamination": decontamination.query,
    "op7_line_templates": line_templates.query,
    "op8_token_store": token_store.query,
    "op9_neighbours": neighbours.query,
}

ORACLES: dict[str, str] = {
    "op13_filter_audit": filter_audit.ORACLE,
    "op7_line_templates": line_templates.ORACLE,
}
