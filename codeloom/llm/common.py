"""Helpers shared by the training-data operators: shared storage, readers, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        at = context._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        context.setCheckpointDir(found)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found if ":/" in found else f"file://{found}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


#: A task of a checkpoint takes so many rows at least, where their number is known to be bounded.
ROWS_IN_TASK = 20_000
LEAST_TASKS = 12


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A copy of ``df`` in the shared folder, so that lost executors cost no recomputation.

    ``rows`` is about how many rows ``df`` has at most; small frames then take few tasks,
    whatever the number of shuffle partitions.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, rows // ROWS_IN_TASK))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now. It does so once the driver has
    collected what refers to them, which a driver with memory to spare puts off; some of it is
    let go by the first collection only."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInPandas`` and the like, whose worker gives unused memory back at a task's end:
    workers that wait for their next task keep theirs otherwise."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


#: Seconds that a worker keeps what it has learned for its next task.
IDLE_SECONDS = 4.0
_IDLE: dict[str, threading.Timer] = {}


def in_use(name: str) -> None:
    """Stops the countdown of ``free_when_idle``."""
    timer = _IDLE.pop(name, None)
    if timer is not None:
        timer.cancel()


def free_when_idle(name: str, free: Callable[[], None]) -> None:
    """Calls ``free`` in this worker unless ``in_use`` is called soon: a stage's tasks share what
    the worker has learned, and later stages don't pay for it."""

    def later() -> None:
        free()
        give_back()

    in_use(name)
    timer = _IDLE[name] = threading.Timer(IDLE_SECONDS, later)
    timer.daemon = True
    timer.start()


class Scratch:
    """Parquet tables in the shared folder that live while an operator needs them."""

    #: Of all operators that ``temporary`` is to clear up after.
    made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codeloom-{tag}-{uuid.uuid4().hex}"
        if Scratch.made is not None:
            Scratch.made.append(self)

    @staticmethod
    @contextmanager
    def temporary() -> Iterator[None]:
        """Drops at its end all tables of operators called within, whose results must have been read."""
        before, Scratch.made = Scratch.made, []
        try:
            yield
        finally:
            own, Scratch.made = Scratch.made, before
            for s in own:
                s.drop()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None, each: int = ROWS_IN_TASK) -> DataFrame:
        """Writes a table and reads it. ``rows`` is about how many rows decide its size; a small table then has
        few files, whatever the number of shuffle partitions, with ``each`` of them in a task."""
        if rows is not None:
            df = df.coalesce(max(LEAST_TASKS, rows // each))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables, or all of them."""
        jvm = self.spark.sparkContext._jvm
        for at in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: So many edges at most are joined in one task; more are contracted first.
EDGES_IN_TASK = 500_000


def joined_in_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges (``a``, ``b``) of a partition by union-find."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    if parent:
        yield pd.DataFrame({"id": list(parent), "component_id": [root(v) for v in parent]})


def components(edges: DataFrame, most: int = EDGES_IN_TASK, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by contraction.

    ``edges`` has long columns ``a`` and ``b``. Returns one row per vertex that has an
    edge to another vertex: ``id`` and ``component_id``, the smallest vertex reachable.
    While there are over ``most`` edges, a round maps every vertex to the neighbour (or itself)
    first in a pseudo-random order and keeps the edges between different images, so paths
    shrink by a constant factor and stars vanish in two rounds. The edges left then fit in
    one task. All state stays in checkpointed frames.
    """
    live = cut(edges.select("a", "b").where("a <> b").distinct())
    n = live.count()
    if n <= most:
        return cut(live.coalesce(1).mapInPandas(joined_in_one, "id long, component_id long"))
    roots, left = None, n
    for _ in range(max_rounds):
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        nearest = both.groupBy(F.col("a").alias("v")).agg(
            F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m")
        )
        own = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("id"))
        image = cut(nearest.select("v", F.least(F.col("m"), own)["id"].alias("to")), 2 * n)
        roots = image.select(F.col("v").alias("id"), F.col("to").alias("root")) if roots is None else through(roots, image, "v", "to", n)
        first = live.join(image.withColumnRenamed("to", "x"), F.col("a") == F.col("v")).select("x", "b")
        second = first.join(image.withColumnRenamed("to", "y"), F.col("b") == F.col("v")).select("x", "y")
        live = cut(
            second.where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            n,
        )
        left = live.count()
        if left <= most:
            break
    else:
        raise RuntimeError("components did not converge")
    if left:
        image = cut(live.coalesce(1).mapInPandas(joined_in_one, "id long, component_id long"))
        roots = through(roots, image.withColumnRenamed("id", "v"), "v", "component_id", n)
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    return roots.join(cut(least, n), "root").select("id", "component_id")


def through(roots: DataFrame, image: DataFrame, key: str, to: str, n: int) -> DataFrame:
    """``roots`` (``id``, ``root``) with each root replaced by its image, where it has one."""
    joined = roots.join(image, roots.root == image[key], "left")
    return cut(joined.select("id", F.coalesce(to, "root").alias("root")), 2 * n)
