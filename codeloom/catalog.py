"""All queries of the code-graph operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import catalog_scan, catalog_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog_scan.QUERIES | catalog_search.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog_scan.ORACLES | catalog_search.ORACLES
