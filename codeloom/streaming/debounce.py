"""Debounced change streams: sessions of file events, and merges of each batch into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_excluded, is_source

GAP = "750 milliseconds"


def interesting(changes: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Changes of source files outside excluded folders."""
    return changes.where(is_source(F.col("path")) & ~is_excluded(F.col("path"), excluded))


def distinct_paths(paths: Column) -> Column:
    """Of paths that are equal but for case, the first one, as it is written."""
    written = F.array_sort(paths)
    alike = F.array_distinct(F.transform(written, F.lower))
    return F.transform(alike, lambda k: F.get(F.filter(written, lambda p: F.lower(p) == k), 0))


#: Buckets of time that one task puts in order.
GROUP = 1000


def sessions(changes: DataFrame, gap: str = GAP) -> DataFrame:
    """Runs of events at most ``gap`` apart: ``first``, ``last``, ``events`` and ``paths``, the number of
    distinct paths without regard to case. For tables; a stream has ``session_paths``.

    Events of one bucket of time as long as the gap are always of one run, so buckets are put in
    order instead of events: each group of ``GROUP`` buckets by itself, and then the groups,
    of which there are as many as the table's time has gaps, divided by ``GROUP``.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = int(changes.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {gap})")).first()[0])
    rows = changes.where("ts is not null").withColumn("at", micros).withColumn("bucket", F.floor(F.col("at") / width))
    buckets = rows.groupBy("bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).withColumn("part", F.floor(F.col("bucket") / GROUP))
    within, order = Window.partitionBy("part").orderBy("bucket"), Window.orderBy("part")
    ends = buckets.groupBy("part").agg(F.max("hi").alias("end")).withColumn("before", F.lag("end").over(order))
    buckets = buckets.join(ends.select("part", "before"), "part")
    before = F.coalesce(F.lag("hi").over(within), "before")
    fresh = F.when(before.isNull() | (F.col("lo") - before > width), F.col("lo"))
    buckets = buckets.withColumn("fresh", fresh)
    opened = buckets.groupBy("part").agg(F.max("fresh").alias("start")).withColumn("open", F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.coalesce(F.last("fresh", True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "open")
    starts = buckets.join(opened.select("part", "open"), "part").select("bucket", start.alias("start"))
    grouped = rows.join(starts, "bucket").groupBy("start", F.lower("path").alias("path")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    out = grouped.groupBy("start").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.count("path").alias("paths"))
    return out.drop("start")


def session_paths(changes: DataFrame, gap: str = GAP) -> DataFrame:
    """The sessions with the changed paths that one incremental run takes, each as it is written. A
    session of a stream has ``overflow`` if the source lost count of its files."""
    # A stream's sessions need a key beside the window; without repositories it is one empty text.
    key = F.col("repository") if "repository" in changes.columns else F.substring("path", 1, 0)
    lost = F.col("kind") == "overflow" if "kind" in changes.columns else F.lit(False)
    grouped = changes.groupBy(F.session_window("ts", gap).alias("w"), key.alias("repository"))
    found = grouped.agg(F.collect_set(F.when(~lost, F.col("path"))).alias("all"), F.max(lost).alias("overflow"))
    return found.select("w.start", "w.end", "repository", distinct_paths(F.col("all")).alias("changed"), "overflow")


#: A batch with more changed files asks for a full run.
MOST_CHANGED = 5000


def start_incremental(stream: DataFrame, store, analyze: Callable[[DataFrame, list[str] | None], tuple | None], module_id: str, checkpoint: str, delay: str = "10 minutes", gap: str = GAP, most: int = MOST_CHANGED):
    """Runs ``analyze(frame of sessions, changed paths)`` for each batch of closed sessions and commits the
    symbols and relationships it returns as a file delta. Beyond ``most`` files, or where the
    source overflowed, the paths are None and the rows returned replace the whole module.
    Nothing (None) is returned for batches that need no commit."""

    def merge(batch: DataFrame, number: int) -> None:
        paths = batch.select(F.explode("changed").alias("p")).groupBy(F.lower("p")).agg(F.min("p").alias("p"))
        changed = [r["p"] for r in paths.select("p").limit(most + 1).collect()]
        full = len(changed) > most or not batch.where("overflow").isEmpty()
        if not changed and not full:
            return
        found = analyze(batch, None if full else sorted(changed))
        if found is None:
            return
        if full:
            store.replace(*found, modules=[module_id], generation=f"stream-{number}")
        else:
            store.replace_files(module_id, sorted(changed), *found, generation=f"stream-{number}")

    wanted = interesting(stream.withWatermark("ts", delay))
    if "kind" in stream.columns:
        wanted = stream.withWatermark("ts", delay).where((F.col("kind") == "overflow") | (is_source(F.col("path")) & ~is_excluded(F.col("path"))))
    closed = session_paths(wanted, gap)
    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).start()
