"""The registry of language modules: by name, what turns a repository's definition into rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources import ingest, scan_ts

Rows = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Module:
    """``analyze(spark, definition)`` gives symbols and relationships; ``suffixes`` are those of its files."""

    name: str
    analyze: Callable[[SparkSession, dict], Rows]
    suffixes: tuple[str, ...] = ()


_MODULES: dict[str, Module] = {}


def register(module: Module) -> None:
    if not module.name.strip():
        raise ValueError("a module needs a name")
    _MODULES[module.name] = module


def names() -> list[str]:
    return sorted(_MODULES)


def get(name: str) -> Module:
    if name not in _MODULES:
        raise ValueError(f"unknown module {name}")
    return _MODULES[name]


def _facts(name: str) -> Callable[[SparkSession, dict], Rows]:
    """Rows of a compiler-backed analyzer, from its lines of JSON at the definition's ``facts`` of that name."""

    def read(spark: SparkSession, definition: dict) -> Rows:
        found = (definition.get("facts") or {}).get(name)
        if not found:
            raise ValueError(f"{name} has no facts to read")
        bad = ingest.malformed_lines(spark, found).limit(1).collect()
        if bad:
            raise ValueError(f"{name} has malformed facts: {bad[0]['value'][:80]}")
        return ingest.analyzer_rows(spark, found)

    return read


def _scan(spark: SparkSession, definition: dict) -> Rows:
    files = ingest.source_files(spark, definition["root_path"], definition.get("excluded_paths"))
    return scan_ts.analyze(files.where(f"lower(path) rlike '{scan_ts.SUFFIXES}'"), definition["id"])


for _name, _suffixes in (("csharp-roslyn", (".cs",)), ("typescript-semantic", (".ts", ".tsx")), ("cpp-clang", (".c", ".cc", ".cpp", ".h", ".hpp"))):
    register(Module(_name, _facts(_name), _suffixes))
register(Module(scan_ts.MODULE, _scan, (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")))
