"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="diamondlake-")
    atexit.register(shutil.rmtree, path, True)
    return path


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Without one, a run on a single machine gets a folder of its own; a
    cluster has no folder that all see, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """``df`` written once and read back: plans that use it more than once start from the files, and a lost executor
    costs no replay. ``partitions`` become folders, which filters prune."""
    spark, path = df.sparkSession, fresh(df.sparkSession, label)
    rows = df.hint("rebalance", *partitions) if partitions else df
    (rows.write.partitionBy(*partitions) if partitions else rows.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
