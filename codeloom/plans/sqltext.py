"""SQL for DuckDB shared by the oracles."""

from __future__ import annotations

from codeloom.sources.views import RELATIONSHIPS, SYMBOLS

SYM_COLUMNS = ("id", "repository_id", "project", "file_path", "name", "qualified_name", "kind", "start_line", "start_column", "end_line", "end_column", "signature", "language", "module_id")
GENERATED_SQL = "regexp_matches(file_path, '(?i)(\\.designer\\.cs|\\.g\\.cs|\\.g\\.i\\.cs|\\.pb\\.cs|assemblyinfo\\.cs)$|/obj/|/generated/')"


def with_views(query: str, *more: str) -> str:
    parts = [f"sym AS MATERIALIZED ({SYMBOLS})", f"rel AS MATERIALIZED ({RELATIONSHIPS})", *more]
    return "WITH " + ", ".join(parts) + " " + query


def tokens_sql(field: str) -> str:
    """Tokens of an ASCII field, by passes that put a space at each edge within a word."""
    runs = f"list_filter(string_split_regex({field}, '[^A-Za-z0-9]+'), lambda r: r <> '')"
    parts = f"array_to_string({runs}, ' ')"
    for a, b in (("([a-z])([A-Z])", "g"), ("([A-Z])([A-Z][a-z])", "g"), ("([A-Za-z])([0-9])", "g"), ("([0-9])([A-Za-z])", "g")):
        parts = f"regexp_replace({parts}, '{a}', '\\1 \\2', '{b}')"
    both = f"list_concat(list_transform({runs}, lambda r: lower(r)), list_filter(string_split(lower({parts}), ' '), lambda r: r <> ''))"
    return f"list_sort(list_distinct({both}))"
