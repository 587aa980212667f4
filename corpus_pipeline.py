"""A corpus pipeline of four stages over ``documents``.

Each stage gets the whole table that the one before kept, as written to Parquet, and does
all its work on it. Only the columns of the documents are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, read_table
from codeloom.llm.op04_language_id import UNKNOWN, language, learn
from codeloom.llm.op05_mixing import documents_before, placed, source_table
from codeloom.llm.op08_bpe import encode_documents, vocabulary_path
from codeloom.llm.op09_jaccard_join import jaccard_components

#: Documents in an output partition of the mixing stage.
PART_DOCS = 8192
MAX_PARTS = 20_000


def columns_of(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from its rows in the struct ``row``, some of them changed."""
    return [changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null, empty or letterless texts, and
    all of them where no labelled text is there to learn from. A document without ``lang`` gets
    the one that is found. Repeated rows and rows without doc_id are judged each; an empty table gives
    an empty one; columns may have any names."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), language(learn(docs)).alias("found"))
    return found.where(F.col("found.lang") != UNKNOWN).select(*columns_of(docs, lang=F.coalesce("row.lang", "found.lang")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents connected by a Jaccard similarity of 0.8 or more on five-word
    shingles, the one with the smallest doc_id, and all that link with none. Rows that share
    a doc_id are one document only where their texts are equal, and then one row stays; rows without
    doc_id stay. Documents are told apart by a 64-bit hash of both. An empty table gives an empty one;
    columns may have any names."""
    key = F.xxhash64("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)), F.col("text").isNull())
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    known = keyed.where("row.doc_id is not null")
    found = jaccard_components(known.select(F.col("key").alias("doc_id"), "row.text"), width=5, num=80, den=100)
    found = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = known.select("key", F.col("row.doc_id").alias("id")).distinct()
    # A large group's minimum is found by partial aggregation.
    kept = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key"))["key"].alias("kept"))
    one = known.join(kept, F.col("key") == F.col("kept")).dropDuplicates(["key"])
    return one.select(*columns_of(docs)).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: rows within files, and files by name. Every row stays,
    repeated ones and those without source too; an empty table gives an empty one."""
    table = source_table(docs)
    mixed = placed(docs, positions=False, table=table)
    # Slots are in files by ranges of about as many documents, however early some sources run out.
    before = documents_before(table)
    rows = before[-1][1] if before else 0
    each = max(PART_DOCS, -(-rows // MAX_PARTS))
    files = max(1, -(-rows // each))
    about = F.lit(float(rows))
    for (t0, d0), (t1, d1) in reversed(list(zip(before, before[1:], strict=False))):
        about = F.when(F.col("mix_slot") < t1, d0 + (F.col("mix_slot") - t0) * ((d1 - d0) / (t1 - t0))).otherwise(about)
    part = F.least(F.floor(about / each), F.lit(files - 1)).cast("int")
    dealt = mixed.repartitionById(files, part).sortWithinPartitions("mix_slot", "mix_within")
    return dealt.select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and digests and the decoded text's digest. A null or empty
    text has none; repeated rows and rows without doc_id have a row each; an empty table gives an empty
    one; other columns than ``doc_id``, ``lang`` and ``source`` are not read."""
    found = encode_documents(docs, vocabulary_path(), digest_only=False, keep=("doc_id", "lang", "source"))
    return found.drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("jaccard_join", keep_one_of_each),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``. Of the tables between them, in the shared folder, only the one
    stays that the last stage reads."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch.temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
