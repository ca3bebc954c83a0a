"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``)."""
    return fresh(spark, label)


#: Spark's own switch: an execution's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *folders: str, mode: str = "error") -> None:
    """``df`` as Parquet. The write's shuffle files go with it, so that a plan of many steps holds the disk of one."""
    spark = df.sparkSession
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        (df.write.partitionBy(*folders) if folders else df.write).mode(mode).parquet(path)
    finally:
        spark.conf.set(CLEAN, was)


def stored(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost executor costs no replay.
    Filters on the columns ``folders`` read only the files that they need."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    write(df, path, *folders)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that no later step reads."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused_name(taken: list[str], wish: str) -> str:
    """``wish`` with a number that no column has."""
    held = {c.lower() for c in taken}
    return next(n for i in range(len(held) + 1) if (n := f"__{wish}{i}") not in held)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in small pieces: a worker then holds the Python objects of some hundred texts, not of ten thousand."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def row_key(*columns: str) -> Column:
    """A key made from content only, so a replayed task gives the same one. Rows that are equal share it."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return F.xxhash64(*named)


def clear(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with only ``names``: extra columns cannot clash with an operator's own."""
    return df.select(*names)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): the least id that each one reaches.

    Alternating large and small stars: every step joins edges with one least neighbour an id, so a hub is a skewed
    join side that Spark can split, never a gathered list. Each round is written, and ends when no edge changes.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = stored(edges, "edges"), None
    while True:
        old = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        forget(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
