"""Checkpoints in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master gets a temporary folder of its own."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    found = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
    if not at.isDefined():
        context.setCheckpointDir(found)
    return found if ":/" in found else f"file://{found}"


def cut(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
