"""Views of symbols for answers of limited size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import estimated_tokens

ORIENTATION, COMPACT, FULL, GRAPH_ONLY = "orientation", "compact", "full", "graph_only"


def _unless(c: str, same: str) -> Column:
    return F.nullif(F.col(c), F.col(same)).alias(c)


def columns(projection: str) -> list[Column]:
    """What a projection shows; a name, signature or end line that repeats another column is null."""
    base = [F.col("id"), F.col("name"), F.col("kind")]
    if projection == GRAPH_ONLY:
        return base
    out = [*base, _unless("qualified_name", "name"), F.col("file_path"), F.col("start_line")]
    if projection == ORIENTATION:
        return out
    out += [F.col("project"), _unless("signature", "name"), _unless("end_line", "start_line")]
    if projection == COMPACT:
        return out
    if projection != FULL:
        raise ValueError(f"no projection {projection}")
    return [*out, F.col("language"), F.col("module_id"), F.col("start_column"), F.col("end_column")]


def project(symbols: DataFrame, projection: str = ORIENTATION) -> DataFrame:
    return symbols.select(*columns(projection))


def tokens_of(projection: str) -> Column:
    """Estimated tokens of a projected row: its texts, without numbers."""
    texts = {GRAPH_ONLY: [], ORIENTATION: ["qualified_name", "file_path"], COMPACT: ["qualified_name", "file_path", "project", "signature"]}
    names = texts.get(projection, ["qualified_name", "file_path", "project", "signature", "language", "module_id"])
    return estimated_tokens(*[F.col(c) for c in ("id", "name", "kind", *names)])


def within_budget(rows: DataFrame, order: list[Column], projection: str = ORIENTATION, max_items: int = 100, max_tokens: int = 4000) -> DataFrame:
    """The longest prefix in ``order`` within both budgets, of one row at least. Only the first
    ``max_items`` rows are sorted into one task."""
    first = project_with_order(rows, order, projection).orderBy("place").limit(max_items)
    by = Window.orderBy("place")
    first = first.withColumn("tokens", tokens_of(projection)).withColumn("rn", F.row_number().over(by))
    first = first.withColumn("total", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return first.where((F.col("rn") == 1) | (F.col("total") <= max_tokens)).drop("place")


def project_with_order(rows: DataFrame, order: list[Column], projection: str) -> DataFrame:
    return rows.select(*columns(projection), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("place"))


def outline_compact(rows: DataFrame) -> DataFrame:
    return rows.select("name", "kind", "start_line")


def outline_without_file(rows: DataFrame) -> DataFrame:
    return project(rows, COMPACT).drop("file_path")


def wire_json(symbols: DataFrame) -> DataFrame:
    """Compact rows as JSON with camel-case names and without nulls."""
    camel = [F.col(n).alias("".join([w if i == 0 else w.title() for i, w in enumerate(n.split("_"))])) for n in project(symbols.limit(0), COMPACT).columns]
    return project(symbols, COMPACT).select("id", F.to_json(F.struct(*camel)).alias("json"))


def diagnostics_split(diagnostics: list[str]) -> tuple[list[str], list[str]]:
    """Summary lines of the TypeScript analysis, and all others."""
    heads = ("ts-semantic (full):", "ts-semantic (incremental):", "tsconfig:")
    summary = [d for d in diagnostics if d.startswith(heads)]
    return summary, [d for d in diagnostics if not d.startswith(heads)]
