"""A syntax scanner for TypeScript and JavaScript: declarations, members, imports and uses.

Files are scanned one by one in Arrow batches; names, enclosing declarations and imports are
then resolved by joins over all files.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import edge_id, language, resolve_relative
from codeloom.operators.store_checks import enclosing, resolve_paths

MODULE = "typescript-syntax"
SUFFIXES = r"\\.([cm]?[jt]s|[jt]sx)$"
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|.)",
    re.S,
)
_DECLARING = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "function": "function", "namespace": "namespace", "module": "namespace", "const": "variable", "let": "variable", "var": "variable"}
_WORDS = frozenset("if for while switch catch return typeof new await function super import export class extends implements interface enum type const let var else do try finally throw in of instanceof case default delete void yield async get set static public private protected readonly abstract this null true false undefined constructor from as declare namespace".split())


@dataclass
class Token:
    kind: str
    text: str
    at: int


def tokens(source: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(source) if m.lastgroup != "skip"]


def scan(source: str) -> tuple[list[dict], list[dict]]:
    """Declarations (``name``, ``kind``, ``owner``, ``start``, ``end``, ``signature``) and uses (``kind``, ``name``, ``at``)."""
    found = tokens(source)
    closes: dict[int, int] = {}
    open_at: list[int] = []
    for i, t in enumerate(found):
        if t.text in "{([" and t.kind == "mark":
            open_at.append(i)
        elif t.text in "})]" and t.kind == "mark" and open_at:
            closes[open_at.pop()] = i
    declared, uses = [], []

    def body_end(i: int) -> tuple[int, int | None]:
        """Where a declaration that begins at token ``i`` ends, and its body's opening brace."""
        while i < len(found):
            t = found[i].text
            if t == "{":
                return closes.get(i, len(found) - 1), i
            if t == ";":
                return i, None
            i = closes.get(i, i) + 1 if t in "([" else i + 1
        return len(found) - 1, None

    def line_of(at: int) -> str:
        return source[at:].split("\n", 1)[0].strip()[:240]

    def declare(i: int, name: Token, kind: str, owner: str, last: int) -> None:
        end = found[min(last, len(found) - 1)]
        declared.append({"name": name.text, "kind": kind, "owner": owner, "start": found[i].at, "end": end.at + len(end.text) - 1, "signature": line_of(found[i].at)})

    def members(first: int, last: int, owner: str) -> None:
        i = first
        while i < last:
            t = found[i]
            after = found[i + 1].text if i + 1 < last else ""
            if t.kind == "name" and (t.text not in _WORDS or t.text == "constructor") and after in ("(", ":", "=", ";", "?", "<", "!"):
                kind = "constructor" if t.text == "constructor" else "method" if after in ("(", "<") else "property"
                before = found[i - 1].text if i > first else ""
                kind = {"get": "getter", "set": "setter"}.get(before, kind) if kind == "method" else kind
                end = body_end(i + 1)[0] if kind != "property" else next((k for k in range(i, last) if found[k].text == ";" or k + 1 < last and found[k + 1].kind == "name" and "\n" in source[found[k].at : found[k + 1].at]), last - 1)
                declare(i, t, kind, owner, min(end, last))
                i = end + 1
            else:
                i = closes.get(i, i) + 1

    def literal(i: int, last: int, owner: str, sign: str) -> None:
        """Members of an object or type literal that a variable or type is declared as."""
        while i < last and found[i].text != "=":
            i = closes.get(i, i) + 1
        at = i + 1
        if not (i < last and at <= last and found[at].text == "{" and at in closes):
            return
        k, end = at + 1, closes[at]
        while k < end:
            t, after = found[k], found[k + 1].text
            until = k
            while until < end and found[until].text not in (",", ";"):
                if sign == ":" and until > k and found[until].kind == "name" and "\n" in source[found[until - 1].at : found[until].at]:
                    break
                until = closes.get(until, until) + 1
            key = t.kind in ("name", "string") and after in (":", "(", "?", ",", "}", ";", "<")
            if key and (t.kind == "name" or after == ":"):
                value = next((found[j].text for j in range(k + 1, min(k + 4, until)) if found[j].text in ("function", "(", "async")), "")
                arrow = any(found[j].text == "=>" for j in range(k, min(until, k + 60)))
                method = after in ("(", "<") or sign == "=" and after == ":" and value and (arrow or value == "function")
                name = Token(t.kind, t.text.strip("\"'`"), t.at)
                declare(k, name, "method" if method else "property", owner, max(k, until - 1))
            k = until + 1 if until < end and found[until].text in (",", ";") else max(until, k + 1)

    for i, t in enumerate(found[:-1]):
        after = found[i + 1]
        previous = found[i - 1].text if i else ""
        if t.kind != "name":
            continue
        if t.text in _DECLARING and after.kind == "name" and after.text not in _WORDS and previous != ".":
            last, brace = body_end(i + 2)
            declare(i, after, _DECLARING[t.text], "", last)
            if t.text == "type" or t.text in ("const", "let", "var"):
                literal(i + 2, last, after.text, ":" if t.text == "type" else "=")
            if t.text in ("class", "interface") and brace is not None:
                members(brace + 1, last, after.text)
                relation = None
                for k in range(i + 2, brace):
                    if found[k].text in ("extends", "implements"):
                        relation = {"extends": "inherits", "implements": "implements"}[found[k].text]
                    elif relation and found[k].kind == "name" and found[k - 1].text in ("extends", "implements", ","):
                        uses.append({"kind": relation, "name": found[k].text, "at": found[k].at})
        elif t.text in ("import", "export") or t.text == "require" and after.text == "(":
            for k in range(i + 1, min(i + 200, len(found))):
                if found[k].kind == "string" and (found[k - 1].text in ("from", "import", "(")):
                    uses.append({"kind": "imports", "name": found[k].text.strip("\"'`"), "at": found[k].at})
                    break
                if found[k].text == ";" or t.text == "export" and found[k].text in _DECLARING:
                    break
        elif t.text not in _WORDS and previous not in _DECLARING:
            if previous == "new":
                uses.append({"kind": "constructs", "name": t.text, "at": t.at})
            elif after.text == "(":
                uses.append({"kind": "calls", "name": t.text, "at": t.at})
            elif previous not in (".", "extends", "implements") and after.text != ":":
                uses.append({"kind": "references", "name": t.text, "at": t.at})
    starts = {d["start"] for d in declared}
    names = {(d["name"], d["start"]) for d in declared}
    return declared, [u for u in uses if u["at"] not in starts and (u["name"], u["at"]) not in names]


class Lines:
    """Line and column (from 1) of offsets, from one table of line starts."""

    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def position(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


FIELDS = "path string, fact string, kind string, name string, owner string, start int, `end` int, line int, col int, end_line int, end_col int, signature string"


def facts(path: str, text: str | None) -> list[tuple]:
    """Rows of ``FIELDS`` of one file: the module, its declarations and its uses."""
    text = text or ""
    position = Lines(text).position
    rows = [(path, "declaration", "module", path.rsplit("/", 1)[-1], "", 0, len(text), 1, 1, *position(len(text)), path)]
    declared, uses = scan(text)
    for d in declared:
        rows.append((path, "declaration", d["kind"], d["name"], d["owner"], d["start"], d["end"], *position(d["start"]), *position(d["end"]), d["signature"]))
    for u in uses:
        rows.append((path, "use", u["kind"], u["name"], "", u["at"], u["at"], *position(u["at"]), *position(u["at"]), ""))
    return rows


class SyntaxFacts:
    """``facts`` as a table function: ``select f.* from files, lateral syntax_facts(path, text) f``."""

    def eval(self, path: str, text: str):
        yield from facts(path, text)


def register_functions(spark: SparkSession) -> None:
    """Makes the scanner known to SQL as ``syntax_facts``."""
    spark.udtf.register("syntax_facts", F.udtf(SyntaxFacts, returnType=FIELDS))


def scan_files(files: DataFrame) -> DataFrame:
    """Facts of all ``files`` (``path``, ``text``), one row each: ``fact`` (declaration or use) with its fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in facts(path, text)]
            yield pd.DataFrame(rows, columns=[f.split()[0].strip("`") for f in FIELDS.split(", ")])

    return files.select("path", "text").mapInPandas(run, FIELDS)


def analyze(files: DataFrame, repository_id: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and relationships of TypeScript and JavaScript files."""
    facts = scan_files(files)
    d = facts.where("fact = 'declaration'")
    qualified = F.concat(F.col("path"), F.lit("."), F.when(F.col("owner") != "", F.concat("owner", F.lit("."))).otherwise(""), F.col("name"))
    qualified = F.when(F.col("kind") == "module", F.col("path")).otherwise(qualified)
    sid = edge_id(F.lit(repository_id), F.col("path"), qualified, F.col("kind"), F.col("start").cast("string"))
    symbols = d.select(
        sid.alias("id"), F.lit(repository_id).alias("repository_id"), F.lit(None).cast("string").alias("project"), F.col("path").alias("file_path"), "name",
        qualified.alias("qualified_name"), "kind", F.col("line").alias("start_line"), F.col("col").alias("start_column"), "end_line", F.col("end_col").alias("end_column"),
        "signature", language(F.col("path")).alias("language"), F.lit(MODULE).alias("module_id"), F.lit(None).cast("string").alias("structural_identity"), "start", "end",
    )
    u = facts.where("fact = 'use'").select(F.col("path").alias("file_path"), F.col("kind").alias("use"), F.col("name").alias("wanted"), F.col("start").alias("at"), "line", "col")
    # Offsets take the place of lines: the shortest declaration around each use.
    around = symbols.where("kind <> 'variable' and kind <> 'property'").select("file_path", "id", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    spots = u.select("file_path", "at").distinct().select("file_path", F.col("at").alias("line"), F.concat_ws("|", "file_path", F.col("at").cast("string")).alias("id"))
    owners = enclosing(around, spots).select(F.col("edge_id").alias("spot"), F.col("owner_id").alias("source_id"))
    owned = u.withColumn("spot", F.concat_ws("|", "file_path", F.col("at").cast("string"))).join(owners, "spot").select("file_path", "use", "wanted", "at", "line", "col", "source_id").distinct()
    by_name = symbols.where("kind <> 'module'").groupBy(F.col("name").alias("wanted")).agg(F.min_by("id", F.struct("file_path", "start")).alias("target_id"))
    named = owned.where("use <> 'imports'").join(by_name, "wanted")
    specs = owned.where("use = 'imports' and wanted like '.%'")
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    specs = specs.withColumn("spec", resolve_relative(F.concat(folder, F.col("wanted"))))
    paths = symbols.where("kind = 'module'").select("file_path", F.col("id").alias("target_id"))
    resolved = resolve_paths(specs.select(F.col("file_path").alias("importer"), "spec").distinct(), paths)
    imported = specs.join(resolved, (F.col("file_path") == F.col("importer")) & (specs["spec"] == resolved["spec"])).select("wanted", "file_path", "use", "at", "line", "col", "source_id", "resolved")
    imported = imported.join(paths.select(F.col("file_path").alias("resolved"), "target_id"), "resolved").drop("resolved")
    edges = named.unionByName(imported.select(named.columns))
    rid = edge_id(F.col("source_id"), F.col("target_id"), F.col("use"), F.col("file_path"), F.col("at").cast("string"))
    relationships = edges.where("source_id <> target_id or use = 'calls'").select(
        rid.alias("id"), F.lit(repository_id).alias("repository_id"), "source_id", "target_id", F.col("use").alias("kind"), "file_path", "line", "col", F.lit("syntax").alias("confidence"),
        language(F.col("file_path")).alias("language"), F.lit(MODULE).alias("module_id"), F.lit(None).cast("string").alias("structural_identity"),
    )
    return symbols.drop("start", "end"), relationships
