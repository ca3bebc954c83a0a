"""Append-only tables: every change is a row with a number, and readers take the latest. One writer at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAGS = "PitchUID string, tag string, pitcher string"
RUNS = "pitcher string, features string, k int"
ASSIGNED = "pitcher string, PitchUID string, cluster int, conf double, run long"
NAMES = "pitcher string, cluster int, name string, run long"
MOVED = "pitcher string, PitchUID string, cluster int, run long"


class Store:
    """Changes of one kind in the Parquet folder ``path``; ``seq`` numbers them in the order of saving."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"{schema}, seq long"

    def read(self) -> DataFrame:
        """All changes; none where nothing was saved yet."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def last(self) -> int:
        return self.read().agg(F.max("seq")).first()[0] or 0

    def save(self, rows: DataFrame) -> int:
        """Appends ``rows`` as one change with one number, which is returned."""
        number = self.last() + 1
        names = [c.split()[0] for c in self.schema.split(", ")][:-1]
        rows.select(*names, F.lit(number).cast("long").alias("seq")).write.mode("append").parquet(self.path)
        return number

    def rows(self, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), self.schema.rsplit(", ", 1)[0])


class Retags:
    """Tags set by hand. An empty tag takes one back; a pitcher's can be cleared together."""

    def __init__(self, spark: SparkSession, root: str):
        self.changes = Store(spark, f"{root}/retags", RETAGS)

    def set(self, pitches: list[str], tag: str | None, pitcher: str) -> int:
        return self.changes.save(self.changes.rows(*[(p, tag or None, pitcher) for p in pitches]))

    def clear(self, pitcher: str) -> int:
        return self.changes.save(self.changes.rows((None, None, pitcher)))

    def live(self) -> DataFrame:
        from ..operators.serving import retags

        return retags(self.changes.read())


class Clusters:
    """Runs of the clustering by pitcher with their assignments, names, and pitches moved by hand. The latest run counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.runs, self.assigned, self.names, self.moved = (
            Store(spark, f"{root}/{n}", s) for n, s in (("runs", RUNS), ("assigned", ASSIGNED), ("names", NAMES), ("moved", MOVED))
        )

    def run(self, pitches: DataFrame, pitcher: str, features: list[str] | None = None, **more) -> int:
        """Clusters a pitcher's pitches and keeps the result. Names and moves of earlier runs no longer count."""
        from ..operators import gmm
        from .shared import written

        found = written(gmm.clusters_of(pitches, pitcher, features, **more), "clusters")
        k = found.agg(F.max("k")).first()[0]
        number = self.runs.save(self.runs.rows((pitcher, ",".join(features or gmm.FEATURES), k)))
        self.assigned.save(found.select(F.col("Pitcher").alias("pitcher"), "PitchUID", "cluster", "conf", F.lit(number).cast("long").alias("run")))
        return number

    def current(self, pitcher: str) -> int | None:
        """The pitcher's latest run; none after it was cleared."""
        last = self.runs.read().where(F.col("pitcher") == pitcher).orderBy(F.desc("seq")).first()
        return last["seq"] if last and last["k"] else None

    def clear(self, pitcher: str) -> int:
        return self.runs.save(self.runs.rows((pitcher, None, 0)))

    def name(self, pitcher: str, cluster: int, name: str | None) -> None:
        number = self.current(pitcher)
        if number is not None:
            self.names.save(self.names.rows((pitcher, cluster, name or None, number)))

    def move(self, pitcher: str, pitches: list[str], cluster: int) -> None:
        number = self.current(pitcher)
        if number is not None:
            self.moved.save(self.moved.rows(*[(pitcher, p, cluster, number) for p in pitches]))

    def _of_run(self, store: Store, number: int) -> DataFrame:
        return store.read().where(F.col("run") == number)

    def assignments(self, pitcher: str) -> DataFrame | None:
        """(PitchUID, cluster, conf) of the latest run, moves applied."""
        from ..operators.serving import hand_assigned

        number = self.current(pitcher)
        return None if number is None else hand_assigned(self._of_run(self.assigned, number).select("PitchUID", "cluster", "conf"), self._of_run(self.moved, number))

    def reviewed(self, pitcher: str) -> DataFrame | None:
        number = self.current(pitcher)
        return None if number is None else self._of_run(self.moved, number).select("PitchUID").distinct()

    def labels(self, pitcher: str) -> DataFrame | None:
        """(cluster, name) of the latest run, the last name of each."""
        from ..operators.serving import latest

        number = self.current(pitcher)
        return None if number is None else latest(self._of_run(self.names, number), ["cluster"]).select("cluster", "name")

    def view(self, pitches: DataFrame, pitcher: str) -> DataFrame:
        """``pitches`` with cluster labels for tags; as they are where the pitcher has no run."""
        from ..operators.serving import cluster_view

        found = self.assignments(pitcher)
        return pitches if found is None else cluster_view(pitches, found, self.labels(pitcher))


def retag_selection(retags: Retags, clusters: Clusters, pitcher: str, pitches: list[str], choice: str | int | None) -> str:
    """A selection of pitches under a new label: the cluster of that number where the pitcher is clustered, else a tag
    (none takes the tag back). Returns which of the two changed."""
    if clusters.current(pitcher) is not None:
        clusters.move(pitcher, pitches, int(choice))
        return "cluster"
    retags.set(pitches, choice, pitcher)
    return "tag"
