"""Tables derived from one state of a graph, written once and read by many queries.

Each table is written when it is first read, into a folder of its own state, so a commit of one
file pays for none of them. A table is written beside its place and moved there, so that
readers see whole tables only; whoever comes second drops the own copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import edges as e
from codeloom.operators import overview as o
from codeloom.operators import search as s


class Pack:
    """``symbols`` with ``length`` (weighted tokens), ``degree_out`` and ``degree_in``; ``relationships``;
    resolved edges by source (``outgoing``) and by target (``incoming``); postings (``terms``), their
    counts (``lexicon``) and one row of totals (``corpus``); ``files``; ``segments`` by module and file.

    Rows are dealt by a hash of their key and id, so that a hot key is in many files, and sorted by
    key within each, so that a lookup reads few row groups of each."""

    def __init__(self, spark: SparkSession, root: str, symbols: Callable[[], DataFrame], relationships: Callable[[], DataFrame]):
        self.spark, self.root, self._symbols, self._relationships = spark, root.rstrip("/"), symbols, relationships
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._schemas: dict[str, object] = {}

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        if not self._fs.exists(self._path(f"{at}/_SUCCESS")):
            made = getattr(self, f"_{name}_table")()
            aside = f"{self.root}/.{name}-{uuid.uuid4().hex}"
            made.write.parquet(aside)
            if self._fs.exists(self._path(f"{at}/_SUCCESS")) or not self._fs.rename(self._path(aside), self._path(at)):
                self._fs.delete(self._path(aside), True)
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(at).schema
        return self.spark.read.schema(self._schemas[name]).parquet(at)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def _base_table(self) -> DataFrame:
        return self._symbols()

    def _relationships_table(self) -> DataFrame:
        return self._relationships()

    def _outgoing_table(self) -> DataFrame:
        found = e.resolved(self.table("relationships"), self.table("base"))
        return found.repartition("source_id", "id").sortWithinPartitions("source_id", "id")

    def _incoming_table(self) -> DataFrame:
        return self.table("outgoing").repartition("target_id", "id").sortWithinPartitions("target_id", "id")

    def _symbols_table(self) -> DataFrame:
        base, degrees = self.table("base"), e.degrees(self.table("outgoing"))
        lengths = self.table("terms").groupBy("id").agg(F.sum("frequency").alias("length"))
        out = base.join(lengths, "id", "left").join(degrees, "id", "left")
        counts = [F.coalesce(c, F.lit(least)).cast("long").alias(c) for c, least in (("length", 1), ("degree_out", 0), ("degree_in", 0))]
        return out.select(*base.columns, *counts).sortWithinPartitions("id")

    def _terms_table(self) -> DataFrame:
        return s.term_frequencies(self.table("base")).repartition("lexeme", "id").sortWithinPartitions("lexeme", "id")

    def _lexicon_table(self) -> DataFrame:
        return self.table("terms").groupBy("lexeme").agg(F.count("*").alias("df")).sortWithinPartitions("lexeme")

    def _corpus_table(self) -> DataFrame:
        return s.corpus_totals(self.table("symbols"))

    def _files_table(self) -> DataFrame:
        return o.file_rollup(self.table("base")).sortWithinPartitions("file_path")

    def _segments_table(self) -> DataFrame:
        rows = [self.table(t).select("module_id", "file_path", *[F.lit(int(t == c)).alias(c) for c in ("base", "relationships")]) for t in ("base", "relationships")]
        found = rows[0].unionByName(rows[1]).groupBy("module_id", "file_path")
        return found.agg(F.sum("base").alias("symbols"), F.sum("relationships").alias("relationships"))

    def index(self) -> s.Index:
        return s.Index(self.table("terms"), self.table("lexicon"), self.table("corpus"))

    def adjacency(self) -> tuple[DataFrame, DataFrame]:
        return self.table("outgoing"), self.table("incoming")
