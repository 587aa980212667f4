from codeloom.schema import RELATIONSHIP, SYMBOL


def symbols(spark, *rows):
    """Rows of (id, name, path) and optionally kind, module, language."""
    full = []
    for id, name, path, *more in rows:
        kind, module = (*more, *("Method", "csharp-roslyn")[len(more):])[:2]
        full.append((id, "repo", "Tests", path, name, f"N.{name}", kind, 1, 1, 1, 10, f"void {name}()", "csharp", module, None))
    return spark.createDataFrame(full, SYMBOL)


def edges(spark, *rows):
    """Rows of (id, source, target) and optionally kind, path, module."""
    full = []
    for id, source, target, *more in rows:
        kind, path, module = (*more, *("calls", "src/A.cs", "csharp-roslyn")[len(more):])[:3]
        full.append((id, "repo", source, target, kind, path, 1, 1, "semantic", "csharp", module, None))
    return spark.createDataFrame(full, RELATIONSHIP)
