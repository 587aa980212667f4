"""Joins and groupings of relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges both of whose ends are symbols."""
    ids = symbols.select("id")
    out = relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(relationships.columns)


def unresolved(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    ids = symbols.select("id")
    no_source = relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    source = relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    no_target = source.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return no_source.select(relationships.columns).unionByName(no_target.select(relationships.columns))


def adjacent(relationships: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges at each of ``nodes`` (``id``): ``node``, ``dir`` (0 out, 1 in), ``other`` and the edge.
    A self-loop comes once, as outgoing. Kinds are case-sensitive; none means all."""
    edges = relationships if not kinds else relationships.where(F.col("kind").isin(kinds))
    n = nodes.select(F.col("id").alias("node"))
    out = n.join(edges, F.col("node") == F.col("source_id")).withColumn("dir", F.lit(0)).withColumn("other", F.col("target_id"))
    back = n.join(edges.where("source_id <> target_id"), F.col("node") == F.col("target_id")).withColumn("dir", F.lit(1)).withColumn("other", F.col("source_id"))
    return out.unionByName(back)


def page(edges: DataFrame, symbol_id: str, outgoing: bool, limit: int = 40) -> DataFrame:
    """The first ``limit`` (1 to 400) edges of a symbol in one direction by edge id, and whether there are more."""
    limit = min(max(limit, 1), 400)
    own = edges.where(F.col("source_id" if outgoing else "target_id") == symbol_id)
    first = own.orderBy("id").limit(limit + 1)
    rank = Window.orderBy("id")
    rows = first.withColumn("rn", F.row_number().over(rank)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return rows.where(F.col("rn") <= limit).withColumn("has_more", F.col("n") > limit).drop("n")


def groups(edges: DataFrame, most_lines: int = 8) -> DataFrame:
    """Edges of one source, target, kind and file: their number and smallest distinct lines.
    Lines are counted first, so that no task holds all lines of a group."""
    key = ("source_id", "target_id", "kind", "file_path")
    each = edges.groupBy(*key, "line").agg(F.count("*").alias("c"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("line").asc_nulls_last()))
    each = each.withColumn("rn", first)
    lines = F.array_sort(F.collect_list(F.when(F.col("rn") <= most_lines, F.col("line"))))
    return each.groupBy(*key).agg(F.sum("c").alias("occurrences"), lines.alias("lines"))


def groups_wire(edges: DataFrame) -> DataFrame:
    """As ``groups``, with the count only where the lines don't show all."""
    return groups(edges).withColumn("count", F.when(F.col("occurrences") > 8, F.col("occurrences"))).drop("occurrences")


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``degree_out`` and ``degree_in`` of every end of an edge."""
    out = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(back).groupBy("id").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in"))
