"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents are in pseudo-random order and cut into blocks. With whole weights w of
sum P, block k of a source may take no slot before floor(k P / w) and must have one before
ceil((k + 1) P / w). Earliest deadline first meets all deadlines, so over any number of
slots each source is less than one block off its share. Slots repeat after P; one
period's slots are found by a fold over P, and each document finds its slot from its
own number in its source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, read_table

BLOCK_DOCS = 16
PERIOD = 1000
EXPONENT = 0.5
BROADCAST_SOURCES = 100_000
_BUCKET_DOCS = 2000
_BUCKET_SLOTS = 50
_GROUP = 1000
_RUN = 500
#: Blocks that one array numbers.
_RANGE = 10_000


def running_total(counts: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller ``order`` within ``keys``. In two levels,
    so that a task has a thousandth of a key's rows, or as many."""
    counts = counts.withColumn("__g", F.floor(F.col(order) / _GROUP))
    groups = counts.groupBy(*keys, "__g").agg(F.sum(n).alias("__s"))
    by = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__b", F.coalesce(F.sum("__s").over(by), F.lit(0))).drop("__s")
    within = Window.partitionBy(*keys, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("__w", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return own.join(groups, [*keys, "__g"]).withColumn("before", F.col("__b") + F.col("__w")).drop("__g", "__b", "__w")


def source_key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def shares(docs: DataFrame, weights: dict[str, float] | None, exponent: float, period: int) -> DataFrame:
    """For each source key: rows ``n``, whole weight ``w`` (one at least) and their sum ``p``."""
    counts = docs.groupBy("__key").agg(F.count("*").alias("n"))
    if weights is None:
        x = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        x = F.coalesce(*[F.when(F.col("__key") == "s" + k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    total = Window.partitionBy(F.lit(0))
    raw = counts.withColumn("x", x).withColumn("all", F.sum("x").over(total)).withColumn("m", F.count("*").over(total))
    slots = F.greatest(F.lit(period), 16 * F.col("m"))
    raw = raw.withColumn("w", F.greatest(F.lit(1), F.round(slots * F.col("x") / F.col("all"))).cast("long"))
    return raw.withColumn("p", F.sum("w").over(total)).select("__key", "n", "w", "p")


def period_slots(table: DataFrame) -> DataFrame:
    """For each source key and block number in the period: its ``slot`` in it. One task takes a step for each
    slot of the period and source: a few seconds for two thousand sources."""
    row = table.groupBy().agg(F.sort_array(F.collect_list(F.struct("__key", "w", "p"))).alias("s")).where(F.size("s") > 0)
    row = row.selectExpr("s", "s[0].p as p", "transform(s, x -> x.w) as w")
    # k: each source's next block; the released block of the earliest deadline takes slot t. Picks are
    # gathered in runs, as an array that grows by one element is copied each time.
    pick = """array_min(filter(transform(w, (x, i) -> named_struct(
                'd', (st.k[i] + 1) * p div x + if((st.k[i] + 1) * p % x = 0, 0, 1), 'i', i, 'r', st.k[i] * p div x)), c -> c.r <= t))"""
    run = f"""aggregate(sequence(from, least(from + {_RUN}, p) - 1),
                named_struct('k', all.k, 'out', cast(array() as array<struct<i:int,k:bigint>>)),
                (st, t) -> aggregate(array({pick}), st, (a, c) -> named_struct(
                  'k', transform(a.k, (k, i) -> if(i = c.i, k + 1, k)), 'out', array_append(a.out, named_struct('i', c.i, 'k', a.k[c.i])))))"""
    row = row.selectExpr(
        "s",
        f"""flatten(aggregate(sequence(cast(0 as bigint), p - 1, cast({_RUN} as bigint)),
              named_struct('k', transform(w, x -> cast(0 as bigint)), 'out', cast(array() as array<array<struct<i:int,k:bigint>>>)),
              (all, from) -> aggregate(array({run}), all, (a, one) -> named_struct('k', one.k, 'out', array_append(a.out, one.out)))
            ).out) as picks""",
    )
    picks = row.select("s", F.posexplode("picks").alias("slot", "pick"))
    return picks.selectExpr("s[pick.i].__key as __key", "pick.k as __k", "cast(slot as bigint) as __slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """All rows of ``docs`` with their place in the mix.

    ``weights`` has target weights by source; without it a source's weight is its number of
    rows to the power ``exponent``. Weights are rounded to whole slots of a period of about ``period``
    slots (16 for each source at least), one slot at least. Adds ``mix_block``, ``mix_weight``,
    ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_position`` (0-based, without gaps, in the
    order of slots and of documents within a block). A source that has run out leaves its slots
    empty; no row is dropped or repeated. Null is a source of its own. Within a source the
    order is by md5 of the doc_id, then doc_id and text; equal rows are placed next to each
    other. All columns are carried; one that has the name of an added column gets ``_of_input`` after it.
    An empty table gives an empty one.
    """
    added = {f"mix_{c}" for c in PLACES}
    names: dict[str, str] = {}
    for c in docs.columns:
        name = f"{c}_of_input" if c in added else c
        while name != c and (name in docs.columns or name in names.values()):
            name += "_"
        names[c] = name
    rows = placed(docs, weights, exponent, block_docs, period)
    return rows.select(*[F.col(f"__row.`{c}`").alias(n) for c, n in names.items()], *[F.col(f"mix_{c}") for c in PLACES])


PLACES = ("block", "weight", "release", "deadline", "slot", "position")


def placed(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, block_docs: int = BLOCK_DOCS, period: int = PERIOD, positions: bool = True, table: DataFrame | None = None) -> DataFrame:
    """As ``mix``, with each row whole in the struct ``__row``, so that its columns may have any names. Without
    ``positions`` each row has its slot and its place in the block (``mix_within``) only, which order
    all rows alike and spare a join of them by slot. ``table`` is that of ``source_table``, if it is there."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), source_key().alias("__key"), hashed.alias("__h"), F.col("doc_id").alias("__id"), tie.alias("__tie"))
    table = source_table(docs, weights, exponent, period) if table is None else table
    # A join by source would bring a large one to one task; the table has a row a source.
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    slots = period_slots(table)
    lead = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    bucket = F.floor(lead * F.ceil(F.col("n") / _BUCKET_DOCS) / 4294967296).cast("long")
    thin = rows.select("__key", "__h").join(table, "__key").withColumn("__bucket", bucket)
    before = running_total(thin.groupBy("__key", "__bucket").agg(F.count("*").alias("c")), ["__key"], "__bucket", "c").drop("c")
    within = Window.partitionBy("__key", "__bucket").orderBy("__h", F.col("__id").asc_nulls_first(), "__tie")
    rows = rows.join(table, "__key").withColumn("__bucket", bucket).repartition("__key", "__bucket")
    rows = rows.withColumn("__r", F.row_number().over(within) - 1).join(before, ["__key", "__bucket"])
    rows = rows.withColumn("__i", F.col("before") + F.col("__r"))
    rows = rows.withColumn("mix_block", F.floor(F.col("__i") / block_docs)).withColumn("__k", F.col("mix_block") % F.col("w"))
    rows = rows.join(slots, ["__key", "__k"]).withColumn("mix_slot", F.expr("p * (mix_block div w) + __slot"))
    rows = rows.withColumn("mix_within", F.col("__i") % block_docs)
    if not positions:
        return rows.select("__row", "mix_slot", "mix_within")
    rows = rows.join(slot_starts(table, slots, block_docs), "mix_slot").withColumn("mix_position", F.col("__first") + F.col("mix_within"))
    return rows.select(
        "__row", "mix_block", (F.col("w") / F.col("p")).alias("mix_weight"), F.expr("mix_block * p div w").alias("mix_release"),
        F.expr("((mix_block + 1) * p + w - 1) div w").alias("mix_deadline"), "mix_slot", "mix_position",
    )


def source_table(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, period: int = PERIOD) -> DataFrame:
    return cut(shares(docs.select(source_key().alias("__key")), weights, exponent, period))


def documents_before(table: DataFrame, block_docs: int = BLOCK_DOCS, points: int = 64) -> list[tuple[int, int]]:
    """About how many documents lie before each of some slots: pairs of both, the last one beyond all slots."""
    last = F.expr(f"p * ((n + {block_docs - 1}) div {block_docs} div w + 1)")
    most = table.agg(F.max(last).alias("t")).first()["t"] or 1
    slots = sorted({0, most, *(math.ceil(most ** (j / points)) for j in range(1, points))})
    each = table.select("n", "w", "p", F.explode(F.array(*[F.lit(t).cast("long") for t in slots])).alias("t"))
    sums = each.groupBy("t").agg(F.sum(F.least("n", F.expr(f"cast(t * double(w) / p * {block_docs} as bigint)"))).alias("d"))
    return sorted((r["t"], r["d"]) for r in sums.collect())


def slot_starts(table: DataFrame, slots: DataFrame, block_docs: int) -> DataFrame:
    """For each used slot the number of documents in all slots before it."""
    # Numbers of blocks in ranges, which are dealt out before they are counted up.
    zero, most = F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_docs)
    ranges = table.withColumn("__most", most).withColumn("__lo", F.explode(F.sequence(zero, F.col("__most"), F.lit(_RANGE).cast("long"))))
    ranges = ranges.repartition("__key", "__lo")
    blocks = ranges.withColumn("mix_block", F.explode(F.sequence(F.col("__lo"), F.least("__most", F.col("__lo") + (_RANGE - 1))))).drop("__lo", "__most")
    blocks = blocks.withColumn("__k", F.col("mix_block") % F.col("w")).join(slots, ["__key", "__k"])
    used = blocks.selectExpr("p * (mix_block div w) + __slot as mix_slot", f"least(n - mix_block * {block_docs}, {block_docs}) as c")
    counted = used.withColumn("__none", F.lit(0))
    return running_total(counted, ["__none"], "mix_slot", "c").select("mix_slot", F.col("before").alias("__first"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in PLACES])


ORACLES = {
    "op5_mix_sources": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cnt AS (SELECT k, count(*) AS n FROM d GROUP BY k),
x AS (SELECT k, n, sqrt(CAST(n AS DOUBLE)) AS x FROM cnt),
wt AS (SELECT k, n, CAST(greatest(1, round(greatest(1000, 16 * (SELECT count(*) FROM x)) * x / (SELECT sum(x ORDER BY k) FROM x))) AS BIGINT) AS w FROM x),
lists AS (SELECT list(w ORDER BY k) AS w, list(k ORDER BY k) AS ks, CAST(sum(w) AS BIGINT) AS p FROM wt),
st AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(w, lambda v: CAST(0 AS BIGINT)) AS ks, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS blk FROM lists
  UNION ALL
  SELECT t + 1, list_transform(kk, lambda v, j: CASE WHEN j = pick2 THEN v + 1 ELSE v END), pick2, kk[pick2]
  FROM (SELECT st.t, st.ks AS kk, lists.p AS p, list_min(list_filter(list_transform(lists.w, lambda v, j:
          CASE WHEN st.ks[j] * lists.p // v <= st.t + 1 THEN ((st.ks[j] + 1) * lists.p + v - 1) // v * 1000000 + j END), lambda v: v IS NOT NULL)) % 1000000 AS pick2
        FROM st, lists WHERE st.t + 1 < lists.p) q),
tmpl AS (SELECT lists.ks[st.pick] AS k, st.blk AS kb, st.t AS t FROM st, lists WHERE st.t >= 0),
r AS (SELECT d.doc_id, d.source, d.k, wt.w, lists.p, row_number() OVER (PARTITION BY d.k ORDER BY h, doc_id) - 1 AS i FROM d JOIN wt ON d.k = wt.k CROSS JOIN lists),
b AS (SELECT r.*, i // 16 AS block FROM r),
s AS (SELECT b.*, p * (block // w) + tmpl.t AS slot FROM b JOIN tmpl ON tmpl.k = b.k AND tmpl.kb = b.block % b.w)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(w AS DOUBLE) / CAST(p AS DOUBLE) AS weight, CAST(block * p // w AS BIGINT) AS release,
       CAST(((block + 1) * p + w - 1) // w AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, i) - 1 AS BIGINT) AS position
FROM s
"""
}
