"""Sources of rows and files: analyzer output, compile databases, folders, the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_excluded, is_source
from codeloom.schema import RELATIONSHIP, SYMBOL
from codeloom.sources.files import SmallFiles


def analyzer_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and relationships from lines of JSON with ``type`` (symbol or relationship) and the row's fields."""
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    out = []
    for name, schema in (("symbol", SYMBOL), ("relationship", RELATIONSHIP)):
        rows = lines.where(kind == name).select(F.from_json("value", schema).alias("r")).select("r.*")
        out.append(rows.where("id is not null"))
    return out[0], out[1]


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``analyzer_rows`` leaves out: no JSON, another type, or without id. Blank lines are none."""
    good = F.get_json_object("value", "$.type").isin("symbol", "relationship") & F.get_json_object("value", "$.id").isNotNull()
    return spark.read.text(path).where((F.trim("value") != "") & ~F.coalesce(good, F.lit(False)))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``directory`` and ``command`` of a compile database; a file's last entry wins."""
    rows = spark.read.schema("directory string, command string, file string, arguments array<string>").json(path, multiLine=True)
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    last = Window.partitionBy("file").orderBy(F.desc("n"))
    rows = rows.withColumn("k", F.row_number().over(last)).where("k = 1")
    return rows.select("file", "directory", F.coalesce("command", F.array_join("arguments", " ")).alias("command"))


def source_files(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """``path`` below the root and ``text`` of all source files outside excluded folders."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.col("path"), "^.*?" + base.split(":")[-1].replace("//", "/").replace(".", r"\."), "")
    rows = files.select(F.ltrim(relative, F.lit("/")).alias("path"), F.col("content").cast("string").alias("text"))
    return rows.where(is_source(F.col("path")) & ~is_excluded(F.col("path"), excluded))


class Catalog:
    """Repository definitions by id, as a small JSON file on any file system that Spark has. A damaged file counts as empty."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        folder, _, self.name = path.rpartition("/")
        self.files = SmallFiles(spark or SparkSession.getActiveSession(), folder if "://" in folder else f"file://{folder}")

    def load(self) -> dict[str, dict]:
        try:
            rows = json.loads(self.files.read(self.name) or "")
            return {r["id"]: r for r in rows}
        except (ValueError, TypeError, KeyError):
            return {}

    def save(self, entries: dict[str, dict]) -> None:
        rows = sorted(entries.values(), key=lambda r: r["id"].lower())
        self.files.fs.mkdirs(self.files.at(""))
        self.files.write(self.name, json.dumps(rows, indent=1))

    def merge(self, entry: dict) -> dict:
        """Adds or changes an entry; fields that are left out or None keep their values."""
        entries = self.load()
        merged = entries.get(entry["id"], {}) | {k: v for k, v in entry.items() if v is not None}
        entries[entry["id"]] = merged
        self.save(entries)
        return merged

    def exclude(self, repository_id: str, pattern: str) -> dict:
        """Adds a pattern unless it is there without regard to case."""
        entries = self.load()
        entry = entries[repository_id]
        have = entry.setdefault("excluded_paths", [])
        if pattern.lower() not in (p.lower() for p in have):
            have.append(pattern)
        self.save(entries)
        return entry
