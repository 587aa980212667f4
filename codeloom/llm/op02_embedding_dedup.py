"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Each tree splits the unit vectors of a label again and again at the median of a random
projection; vectors near the cut go to both sides. Vectors are compared within leaves
only. Splits are fitted on a bounded sample and every vector is routed through every tree; leaves
that come out too large, as they do where the sample is a small share of all, are split on by
their own vectors, so that leaves don't grow with the input. What can't be split, a
dense group, is compared in pairs of blocks, each in a task of its own. A
pair that meets in several leaves counts in the first only, so leaves send counts and the edges
of spanning trees, never their pairs. There are as many trees as the depth needs for the recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, components, cut, read_table, tidy

COSINE = 0.93
#: A pair of just that cosine may share no leaf with this probability, ...
MISS = 2e-4
#: ... where it stays together in a split with this one, at ``SPILL`` (measured: the test of recall).
TOGETHER = 0.93
MOST_TREES = 64
LEAF = 256
MOST_IN_TASK = 2048
#: A leaf of up to so many vectors is split on in one task; a larger one is compared in blocks.
MOST_TO_SPLIT = 200_000
BLOCK = 1024
MAX_DEPTH = 40
#: About how many vectors the splits are fitted on, at most.
SAMPLE = 20_000
#: Half width of the spill, as a share of the standard projection of the largest linked distance.
SPILL = 0.3
SEED = 20_240_501


def direction(tree: int, depth: int, dim: int) -> np.ndarray:
    d = np.random.default_rng((SEED, tree, depth, dim)).standard_normal(dim)
    return d / np.linalg.norm(d)


class Tree:
    """One label's tree: thresholds and children by node; a leaf has no children."""

    def __init__(self) -> None:
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.depth: list[int] = []

    def node(self, depth: int) -> int:
        for a, v in ((self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.depth, depth)):
            a.append(v)
        return len(self.left) - 1


def margin(cosine: float, dim: int) -> float:
    return SPILL * math.sqrt(2 - 2 * cosine) / math.sqrt(dim)


def trees_for(vectors: float) -> int:
    """How many trees miss a pair with a probability of ``MISS`` at most, for a label of so many vectors."""
    depth = max(1, math.ceil(math.log2(max(2.0, 2 * vectors / LEAF))))
    return min(MOST_TREES, max(4, math.ceil(math.log(MISS) / math.log(1 - TOGETHER**depth))))


def fit(unit: np.ndarray, tree: int, weight: float, spill: float) -> Tree:
    """Splits until a node stands for at most ``LEAF`` vectors (``weight`` for each sampled one),
    has too few sampled ones, or so many are near the cut that both sides have more pairs than it has."""
    out = Tree()
    projected: dict[int, np.ndarray] = {}
    todo = [(out.node(0), np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        depth = out.depth[node]
        if len(rows) * weight <= LEAF or len(rows) < 8 or depth >= MAX_DEPTH:
            continue
        if depth not in projected:
            projected[depth] = unit @ direction(tree, depth, unit.shape[1])
        p = projected[depth][rows]
        t = float(np.median(p))
        sides = rows[p < t + spill], rows[p >= t - spill]
        if sum(len(x) ** 2 for x in sides) > len(rows) ** 2:
            continue
        out.threshold[node] = t
        out.left[node], out.right[node] = out.node(depth + 1), out.node(depth + 1)
        todo += list(zip((out.left[node], out.right[node]), sides, strict=True))
    return out


def route(tree: Tree, number: int, unit: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves: a pair for each leaf a row comes to."""
    left, right, cut_at = (np.array(x) for x in (tree.left, tree.right, tree.threshold))
    rows, nodes = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(MAX_DEPTH + 1):
        leaf = left[nodes] < 0
        done.append((rows[leaf], nodes[leaf]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        if not len(rows):
            break
        p = (unit @ direction(number, depth, unit.shape[1]))[rows]
        lo, hi = p < cut_at[nodes] + spill, p >= cut_at[nodes] - spill
        rows, nodes = np.concatenate((rows[lo], rows[hi])), np.concatenate((left[nodes[lo]], right[nodes[hi]]))
    return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def unpacked(packed: pd.Series) -> np.ndarray:
    """Vectors in double precision, of packed ones that begin with the number of bytes of a component."""
    return np.stack([np.frombuffer(b, dtype=f"<f{b[0]}", offset=1) for b in packed]).astype(np.float64)


def unit_vectors(packed: pd.Series) -> np.ndarray:
    x = unpacked(packed)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``dim`` and the packed vector ``v`` of the rows that may link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite & some)

    # Single precision stays so on the way.
    size = 4 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else 8

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [bytes([size]) + (np.asarray(e, dtype=f"<f{size}") + 0).tobytes() for e in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "dim": [len(p) // size for p in packed], "v": packed})

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInPandas(pack, "vec_id long, label string, dim int, v binary")


def sampled_forest(distinct: DataFrame, cosine: float) -> dict[tuple[str, int], list[Tree]]:
    """Trees by label and size, from about ``SAMPLE`` vectors chosen by a hash of their ids."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("vec_id", "k1"), F.lit(1_000_000)) < int(share * 1_000_000))
    by: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
    for r in sample.select("label", "dim", "vec_id", "v").collect():
        by.setdefault((r["label"], r["dim"]), []).append((r["vec_id"], bytes(r["v"])))
    out = {}
    for k, rows in sorted(by.items()):
        if len(rows) / share > LEAF:
            unit = unit_vectors(pd.Series([v for _, v in sorted(rows)]))
            out[k] = [fit(unit, t, 1 / share, margin(cosine, k[1])) for t in range(trees_for(len(rows) / share))]
    return out


def split_on(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """The vectors of one large leaf with the leaves of a tree of their own: (``node``, ``label``, ``dim``, ``key``)."""
    key, dim = int(part["key"].iloc[0]), int(part["dim"].iloc[0])
    unit, spill = unit_vectors(part["v"]), margin(cosine, dim)
    # Directions that no other leaf has.
    number = int(np.random.default_rng((SEED, key & (1 << 63) - 1)).integers(1 << 20, 1 << 40))
    rows, nodes = route(fit(unit, number, 1.0, spill), number, unit, spill)
    with np.errstate(over="ignore"):
        keys = (np.uint64(key & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15) + nodes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    return part[["node", "label", "dim"]].iloc[rows].assign(key=keys)


def compare(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one leaf, or two blocks of it: for each vector the links that count here, and the
    smallest vector it is connected to."""
    key, cross = int(part["key"].iloc[0]), int(part["i"].iloc[0]) != int(part["j"].iloc[0])
    x = unpacked(part["v"])
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(norm, norm) >= cosine
    np.fill_diagonal(near, False)
    if cross:
        chunk = part["chunk"].to_numpy()
        near &= chunk[:, None] != chunk[None, :]
    ids, times = part["node"].to_numpy(), part["times"].to_numpy()
    if not near.any():
        return pd.DataFrame({"node": ids[:0], "links": times[:0], "to": ids[:0]})
    own = np.flatnonzero(near.any(axis=1))
    near, ids, times = near[np.ix_(own, own)], ids[own], times[own]
    first = near
    lists = part["before"].iloc[own]
    keys, at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *lists]), return_inverse=True)
    if len(keys):
        held = np.repeat(np.arange(len(own)), [len(b) for b in lists])
        more = np.bincount(at) > 1
        place = np.cumsum(more) - 1
        met = np.zeros((len(own), int(more.sum())), dtype=np.float32)
        met[held[more[at]], place[at[more[at]]]] = 1
        first = near & ~(met @ met.T > 0)
    to = ids.copy()
    while True:
        least = np.minimum(to, np.where(near, to[None, :], np.iinfo(np.int64).max).min(axis=1))
        if np.array_equal(least, to):
            break
        to = least
    return pd.DataFrame({"node": ids, "links": first @ times, "to": to})


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``n_links``,
    ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``cosine``, of the pairs that meet in a leaf. A vector that is null, zero or has a null or
    non-finite component links with nothing, nor does one of another length. Equal vectors of
    a label are compared as one and link with each other. Rows that share a vec_id are vectors of their own,
    and each counts. A null vec_id links with nothing and is kept as its own (null) component.
    An empty table gives an empty one; other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    valid = scratch.keep(valid_vectors(vectors.select("vec_id", "embedding", "label")), "valid")
    hashed = valid.select("vec_id", "label", "dim", "v", F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", "label", F.lit(1)).alias("k2"))
    groups = cut(hashed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")))
    rep = groups.select(F.col("rep").alias("vec_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2"), "times")
    distinct = hashed.join(rep, "vec_id").where("k1 = r1 and k2 = r2").dropDuplicates(["vec_id", "k1", "k2"]).drop("r1", "r2")
    distinct = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    forest = spark.sparkContext.broadcast(sampled_forest(distinct, cosine))

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), part in batch.groupby(["label", "dim"]):
                trees = forest.value.get((label, dim))
                rows, keys = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
                if trees:
                    unit, spill = unit_vectors(part["v"]), margin(cosine, int(dim))
                    found = [route(t, i, unit, spill) for i, t in enumerate(trees)]
                    rows = np.concatenate([r for r, _ in found])
                    keys = np.concatenate([n + (i << 32) for i, (_, n) in enumerate(found)])
                yield part[["node", "label", "dim"]].iloc[rows].assign(key=keys)

    leaf = ["label", "dim", "key"]
    fields = "node long, label string, dim int, key long"
    routed = scratch.keep(distinct.select("label", "dim", "node", "v").mapInPandas(tidy(to_leaves), fields), "routed")
    sizes = lambda rows: rows.groupBy(*leaf).agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_TASK)
    large = cut(sizes(routed))
    again = large.where(F.col("n") <= MOST_TO_SPLIT).select(*leaf)
    if not again.isEmpty():
        held = routed.join(again, leaf).join(distinct.select("node", "label", "dim", "v"), ["node", "label", "dim"])
        split = held.groupBy(*leaf).applyInPandas(lambda part: split_on(part, cosine), fields)
        routed = scratch.keep(routed.join(again, leaf, "left_anti").select("node", *leaf).unionByName(split), "split")
        large = cut(sizes(routed))
    # A vector's leaves go with it, for the first that two vectors share.
    leaves = routed.groupBy("node", "label", "dim").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    placed = leaves.join(distinct, ["node", "label", "dim"]).withColumn("key", F.explode("keys"))
    blocks = large.select(*leaf, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(blocks, leaf, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    dealt = dealt.select(*leaf, "i", "j", "chunk", "node", "times", "v", F.filter("keys", lambda k: k < F.col("key")).alias("before"))
    found = dealt.groupBy("label", "dim", "key", "i", "j").applyInPandas(lambda part: compare(part, cosine), "node long, links long, to long")
    found = scratch.keep(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "node")
    named = distinct.select("node", "vec_id", "k1", "k2", "times").join(counts, "node", "left").join(joined, "node", "left")
    named = named.withColumn("component", F.coalesce("component_id", "node")).drop("component_id")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = scratch.keep(named.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"), "named")
    scratch.drop("distinct", "routed", "split", "found")
    linked = hashed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = alone(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def alone(vectors: DataFrame) -> DataFrame:
    """The rows that ``valid_vectors`` leaves out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(finite & some, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return vectors.where(~good).select(F.col("vec_id").cast("long").alias("vec_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"))


#: All pairs of a label: exact, as the forest is where no label has more vectors than a leaf.
ORACLES = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}),
reach(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.c AS component_id, least.c = v.vec_id AS kept FROM v JOIN least ON least.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
}
