"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as generated, as source and as an excluded folder.
GENERATED = r"(?i)(\.designer\.cs|\.g\.cs|\.g\.i\.cs|\.pb\.cs|assemblyinfo\.cs)$|/obj/|/generated/"
EXCLUDED_FOLDERS = (".git", ".tmp", "node_modules", "dist", "build", "coverage", "bin", "obj")
SOURCE_SUFFIXES = (".cs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".inl")
FIELD_WEIGHTS = {"name": 10, "qualified_name": 4, "signature": 2, "file_path": 1}
WORD_GAP = r"[^\p{L}\p{Nd}]+"
WORD_EDGE = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def normalize_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normalize(c: Column) -> Column:
    return F.lower(normalize_path(c))


def tokens(c: Column) -> Column:
    """Distinct lower-cased identifiers and their camel-case and digit parts, in order."""
    runs = F.filter(F.split(c, WORD_GAP), lambda r: r != "")
    both = F.transform(runs, lambda r: F.concat(F.array(F.lower(r)), F.transform(F.split(r, WORD_EDGE), F.lower)))
    return F.array_sort(F.array_distinct(F.flatten(both)))


def trigrams(c: Column) -> Column:
    """Distinct substrings of three characters of the normal form, in order."""
    n = normalize(c)
    each = F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))
    return F.when(F.length(n) >= 3, F.array_sort(F.array_distinct(each))).otherwise(F.array().cast("array<string>"))


def signature_line(c: Column, most: int = 240) -> Column:
    return F.substring(F.trim(F.get(F.split(c, "\r\n|\n|\r"), 0)), 1, most)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def is_excluded(path: Column, patterns: list[str] | None = None) -> Column:
    """A whole folder name on the exclusion list, or any non-blank pattern within the path."""
    out = F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*map(F.lit, EXCLUDED_FOLDERS)))
    for p in patterns or []:
        if p.strip():
            out = out | contains(normalize_path(path), p.replace("\\", "/"))
    return out


def is_source(path: Column) -> Column:
    return path.rlike("(?i)(" + "|".join(s.replace(".", r"\.") for s in SOURCE_SUFFIXES) + ")$")


def language(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.endswith(".cs"), "csharp")
        .when(p.rlike(r"\.(c|h)$"), "c")
        .when(p.rlike(r"\.(cc|cpp|cxx|hpp|hh|hxx|inl)$"), "cpp")
        .when(p.endswith("x"), "tsx")
        .when(p.endswith("ts"), "typescript")
        .otherwise("javascript")
    )


def contains(c: Column, part: str) -> Column:
    return F.instr(F.lower(c), part.lower()) > 0


def resolve_relative(path: Column) -> Column:
    """Folds ``.`` and ``..`` segments; a ``..`` with nothing before it is dropped."""
    parts = F.filter(F.split(normalize_path(path), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def storage_slug(c: Column) -> Column:
    short = F.substring(F.regexp_replace(c, r"[^\p{L}\p{Nd}\-_.]", "-"), 1, 48)
    return F.concat(short, F.lit("__"), F.substring(F.sha2(c.cast("binary"), 256), 1, 10))


def edge_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def estimated_tokens(*fields: Column) -> Column:
    """A quarter of the characters of all emitted fields and 72 for the frame, rounded up."""
    total = sum((F.coalesce(F.length(f.cast("string")), F.lit(0)) for f in fields), F.lit(72 + 3))
    return F.greatest(F.lit(1), F.floor(total / 4)).cast("long")
