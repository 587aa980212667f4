"""Counts and top lists over a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import contains, is_generated
from codeloom.operators.edges import degrees

TEXTUAL = "textual-evidence"


def top_counts(rows: DataFrame, key: Column, most: int) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)


def kinds(symbols: DataFrame) -> DataFrame:
    return top_counts(symbols, F.col("kind"), 30)


def languages(symbols: DataFrame) -> DataFrame:
    return top_counts(symbols, F.col("language"), 12)


def projects(symbols: DataFrame) -> DataFrame:
    return top_counts(symbols, F.coalesce("project", F.lit("(none)")), 30)


def edge_kinds(relationships: DataFrame) -> DataFrame:
    return top_counts(relationships, F.col("kind"), 12)


def top_files(symbols: DataFrame, include_generated: bool = False) -> DataFrame:
    rows = symbols.where(F.col("kind") != TEXTUAL)
    if not include_generated:
        rows = rows.where(~is_generated(F.col("file_path")))
    return top_counts(rows, F.col("file_path"), 20)


def hubs(symbols: DataFrame, edges: DataFrame | None = None, include_generated: bool = False) -> DataFrame:
    """Symbols by number of edge ends. Degrees are counted over ids alone before any join, so hot
    symbols are reduced on the map side; without ``edges`` the symbols have them already."""
    if edges is not None:
        symbols = symbols.join(degrees(edges), "id")
    rows = symbols.where(F.col("kind") != TEXTUAL).withColumn("degree", F.col("degree_out") + F.col("degree_in")).where("degree > 0")
    if not include_generated:
        rows = rows.where(~is_generated(F.col("file_path")))
    return rows.select("id", "name", "qualified_name", "kind", "file_path", "degree").orderBy(F.desc("degree"), "id").limit(20)


def totals(symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    s = symbols.agg(F.count("*").alias("symbols")).withColumn("k", F.lit(1))
    r = relationships.agg(F.count("*").alias("relationships")).withColumn("k", F.lit(1))
    return s.join(r, "k").drop("k")


def file_rollup(symbols: DataFrame) -> DataFrame:
    """Each file's symbols that are no textual evidence, language (the last of several) and visibility."""
    out = symbols.groupBy("file_path").agg(
        F.count_if(F.col("kind") != TEXTUAL).alias("symbol_count"), F.max("language").alias("language")
    )
    return out.withColumn("visible", F.col("symbol_count") > 0)


def list_files(symbols: DataFrame, part: str | None = None, limit: int = 500) -> DataFrame:
    """Visible files by path, one more than ``limit`` (1 to 2000) so that the caller sees if there are more."""
    return list_rollup(file_rollup(symbols), part, limit)


def list_rollup(files: DataFrame, part: str | None = None, limit: int = 500) -> DataFrame:
    """As ``list_files``, of the rows of ``file_rollup``."""
    limit = min(max(limit, 1), 2000)
    rows = files.where("visible").drop("visible")
    if part and part.strip():
        rows = rows.where(contains(F.col("file_path"), part.replace("\\", "/")))
    return rows.orderBy("file_path").limit(limit + 1)


def outline(symbols: DataFrame, path: str, most: int = 500, more: int = 0) -> DataFrame:
    """A file's symbols in order of position, without textual evidence; ``more`` rows beyond the limit
    (500 at most) show whether that left any out."""
    most = min(max(most, 1), 500) + more
    path = path.replace("\\", "/")
    rows = symbols.where((F.col("file_path") == path) & (F.col("kind") != TEXTUAL))
    return rows.orderBy("start_line", "start_column", "id").limit(most)


def purge_count(symbols: DataFrame, pattern: str) -> DataFrame:
    return symbols.where(contains(F.col("file_path"), pattern)).agg(F.count("*").alias("removed"))
