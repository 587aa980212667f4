"""Bounded breadth-first traversal and the queries built on it.

A level starts from its frontier, so that only the frontier's own edges are read, ranked and
looked up. The nodes of an answer are bounded by its limit (2,000 at most), so they are the
only thing the driver holds between levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.edges import groups, page, resolved
from codeloom.sources.shared import cut

FAN_OUT = 500


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


Adjacency = tuple[DataFrame, DataFrame]
#: So many ids at most are sent along with a plan to be joined.
MOST_SENT = 100_000


def near(symbols: DataFrame, relationships: DataFrame, frontier: list[str], kinds: list[str] | None, adjacency: Adjacency | None) -> DataFrame:
    """The resolved edges at the nodes of a bounded frontier, as ``adjacent`` gives them.

    ``adjacency`` has all resolved edges, by source and by target. Without it the frontier's
    own edges come first and only their other ends are looked up among the symbols.
    """
    spark = symbols.sparkSession
    ids = F.broadcast(spark.createDataFrame([(n,) for n in frontier], "node string"))
    outgoing, incoming = adjacency or (relationships, relationships)
    if kinds:
        outgoing, incoming = (x.where(F.col("kind").isin(kinds)) for x in (outgoing, incoming))
    # The range of the ids prunes row groups of tables that are sorted by them.
    within = lambda c: F.col(c).between(min(frontier), max(frontier))
    out = outgoing.where(within("source_id")).join(ids, F.col("source_id") == F.col("node")).withColumn("dir", F.lit(0)).withColumn("other", F.col("target_id"))
    back = incoming.where(within("target_id") & (F.col("source_id") != F.col("target_id"))).join(ids, F.col("target_id") == F.col("node")).withColumn("dir", F.lit(1)).withColumn("other", F.col("source_id"))
    found = out.unionByName(back)
    if adjacency is None:
        found = cut(found)
        others = found.select(F.col("other").alias("id")).distinct()
        if found.count() <= MOST_SENT:
            others = F.broadcast(others)
        known = symbols.select("id").join(others, "id", "left_semi")
        found = found.join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    return found


def capped(edges: DataFrame, cap: int = FAN_OUT) -> DataFrame:
    """The first ``cap`` edges of each node, outgoing before incoming, each by id, with ``rn``; and the one after."""
    rank = Window.partitionBy("node").orderBy("dir", "id")
    return edges.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= cap + 1)


def traverse(symbols: DataFrame, relationships: DataFrame, root: str, depth: int = 2, limit: int = 80, kinds: list[str] | None = None, cap: int = FAN_OUT, adjacency: Adjacency | None = None) -> Graph:
    """All nodes within ``depth`` (0 to 5) steps of ``root`` in either direction, up to ``limit``
    (1 to 2,000) of them, and the edges met on the way.

    A level's edges are taken in the order of the node they were met from, then outgoing
    before incoming, then by id; an edge to a new node is kept while the limit allows it.
    At most ``cap`` edges of a node are looked at. Anything left out sets ``truncated``. An
    unknown root gives an empty graph. ``adjacency`` is as for ``near``.
    """
    spark = symbols.sparkSession
    depth, limit = min(max(depth, 0), 5), min(max(limit, 1), 2000)
    none = relationships.limit(0)
    if symbols.where(F.col("id") == root).isEmpty():
        return Graph(symbols.limit(0), none, False)
    nodes, frontier, kept, truncated = [root], [root], None, False
    for _ in range(depth):
        if not frontier:
            break
        met = capped(near(symbols, relationships, frontier, kinds, adjacency), cap)
        # Met before: in this level from a smaller node, or kept by an earlier one.
        first = Window.partitionBy("id").orderBy(F.col("over"), "node", "dir")
        met = met.withColumn("over", F.col("rn") > cap).withColumn("k", F.row_number().over(first))
        if kept is not None:
            met = met.join(kept.select("id", F.lit(True).alias("old")), "id", "left")
        else:
            met = met.withColumn("old", F.lit(None).cast("boolean"))
        # Both lists have at most ``limit`` ids.
        known = spark.createDataFrame([(n, True) for n in nodes], "other string, known boolean")
        met = cut(met.where("over or (k = 1 and old is null)").join(F.broadcast(known), "other", "left"))
        fresh = met.where("not over and known is null").groupBy("other").agg(F.min(F.struct("node", "dir", "id")).alias("at"))
        room = limit - len(nodes)
        found = fresh.select("other", "at").orderBy("at").limit(room + 1).select("other").union(met.where("over").limit(1).select(F.lit(None).cast("string"))).collect()
        admitted = [r["other"] for r in found if r["other"] is not None]
        truncated |= len(admitted) > room or len(found) > len(admitted)
        admitted = admitted[:room]
        nodes += admitted
        frontier = admitted
        inside = spark.createDataFrame([(n,) for n in nodes], "other string")
        own = met.where("not over").join(F.broadcast(inside), "other", "left_semi").select(relationships.columns)
        kept = own if kept is None else kept.unionByName(own)
    wanted = spark.createDataFrame([(n,) for n in nodes], "id string")
    out = symbols.where(F.col("id").between(min(nodes), max(nodes))).join(F.broadcast(wanted), "id", "left_semi")
    out = out.orderBy(F.when(F.col("id") == root, 0).otherwise(1), "qualified_name", "id")
    return Graph(out, none if kept is None else kept, truncated)


def involved(graph: Graph, edges: DataFrame, root: str) -> Graph:
    """The given edges of a graph, and the nodes at their ends with the root."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id"))).distinct()
    nodes = graph.nodes.join(ends, "id", "left_semi").unionByName(graph.nodes.where(F.col("id") == root)).dropDuplicates(["id"])
    return Graph(nodes, edges, graph.truncated)


def find_callers(symbols: DataFrame, relationships: DataFrame, root: str, depth: int = 2, limit: int = 80, kinds: list[str] | None = None, wide: bool = False, adjacency: Adjacency | None = None) -> Graph:
    kinds = kinds or (["calls", "references"] if wide else ["calls"])
    graph = traverse(symbols, relationships, root, depth, limit, kinds, adjacency=adjacency)
    return involved(graph, graph.edges.where(F.col("target_id") == root), root)


def find_callees(symbols: DataFrame, relationships: DataFrame, root: str, depth: int = 2, limit: int = 80, kinds: list[str] | None = None, wide: bool = False, adjacency: Adjacency | None = None) -> Graph:
    kinds = kinds or (["calls", "constructs", "references"] if wide else ["calls", "constructs"])
    graph = traverse(symbols, relationships, root, depth, limit, kinds, adjacency=adjacency)
    return involved(graph, graph.edges.where(F.col("source_id") == root), root)


def find_references(symbols: DataFrame, relationships: DataFrame, root: str, depth: int = 2, limit: int = 80, adjacency: Adjacency | None = None) -> Graph:
    graph = traverse(symbols, relationships, root, depth, limit, ["references"], adjacency=adjacency)
    return involved(graph, graph.edges.where((F.col("source_id") == root) | (F.col("target_id") == root)), root)


def direct_callers(symbols: DataFrame, relationships: DataFrame, root: str) -> DataFrame:
    """All resolved calls of a symbol, whatever else it is linked to."""
    return resolved(relationships.where((F.col("target_id") == root) & (F.col("kind") == "calls")), symbols)


def neighbors(symbols: DataFrame, out_page: DataFrame, in_page: DataFrame, root: str, most: int = 200) -> DataFrame:
    """Other ends of the edges of both pages, the symbol itself left out, by id."""
    ends = out_page.select(F.col("target_id").alias("id")).union(in_page.select(F.col("source_id"))).distinct().where(F.col("id") != root)
    return symbols.join(ends, "id", "left_semi").orderBy("id").limit(most)


def symbol_detail(symbols: DataFrame, relationships: DataFrame, root: str, limit: int = 40, projected: bool = False, adjacency: Adjacency | None = None) -> dict[str, DataFrame]:
    """A symbol with its pages of edges in both directions and its neighbours."""
    own = symbols.where(F.col("id") == root)
    if own.isEmpty():
        raise KeyError(f"no symbol {root}")
    if adjacency is None:
        edges = resolved(relationships.where((F.col("source_id") == root) | (F.col("target_id") == root)), symbols)
        adjacency = edges, edges
    outgoing, incoming = page(adjacency[0], root, True, limit), page(adjacency[1], root, False, limit)
    near = neighbors(symbols, outgoing, incoming, root)
    if projected:
        return {"symbol": own, "outgoing": groups(outgoing), "incoming": groups(incoming), "neighbors": near.select("id", "name", "kind")}
    return {"symbol": own, "outgoing": outgoing, "incoming": incoming, "neighbors": near}
