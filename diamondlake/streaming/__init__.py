"""Incremental ingest as a file stream. State never crosses files, so no stateful operator is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fold import annotate
from ..sources import ingest, layout

FILES_A_BATCH = 200
BINARY = "path string, modificationTime timestamp, length long, content binary"


def serve_games(spark: SparkSession, raw: str, tree: str, state: str, files: int = FILES_A_BATCH):
    """A started query that takes new game files under ``raw`` to the served tree, a bounded number a batch.

    The source remembers files in ``state/source``. Each batch's status goes to a folder of its number, so a batch that
    is run again overwrites it; rows of files already in the ledger are not written twice.
    """
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
    names = source.schema(BINARY).option("maxFilesPerTrigger", files).load(raw).select("path")

    def one(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if not paths:
            return
        out = ingest.ingest(spark, paths, _ledger(spark, state, number))
        layout.write_tree(layout.routed(annotate(out["clean"])), tree)
        out["status"].write.mode("overwrite").parquet(f"{state}/ledger/batch={number}")

    return names.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/source").trigger(availableNow=True).start()


def _ledger(spark: SparkSession, state: str, number: int) -> DataFrame | None:
    if not number:
        return None
    return spark.read.schema("file_name string, status string").parquet(*[f"{state}/ledger/batch={i}" for i in range(number)])
