"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that has it; a module may have ``ORACLES`` by query name.
QUERIES = {
    "op1_token_files": "op01_token_files",
    "op2_embedding_dedup": "op02_embedding_dedup",
    "op3_html_text": "op03_html_text",
    "op4_language_id": "op04_language_id",
    "op5_mix_sources": "op05_mixing",
    "op6_url_filter": "op06_url_filter",
    "op7_fingerprint": "op07_fingerprint",
    "op8_bpe": "op08_bpe",
    "op9_jaccard_join": "op09_jaccard_join",
    "op10_license_scan": "op10_license_scan",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"codeloom.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in dict.fromkeys(QUERIES.values()):
        found |= getattr(import_module(f"codeloom.llm.{module}"), "ORACLES", {})
    return found
