"""Compositions: whole reports, model training and storage, exports, overlay summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POOLED_LEAGUES, POOLED_LEVEL
from ..sources.layout import Tree
from . import knn, reports, runs, serving, surfaces

PITCHER_SURFACES = ["whiff", "called_strike", "hard_hit"]
BATTER_SURFACES = ["exit_speed", "whiff", "chase"]


def pitcher_report(rows: DataFrame, pool: DataFrame | None = None, hands: list[str] = (), counts: list[str] = ()) -> dict[str, DataFrame]:
    """Tables of one pitcher's report. Splits apply to the arsenal and the surfaces; the caller persists ``rows``,
    which every table reads."""
    part = rows.where(reports.hand_split(list(hands)) & reports.count_split(list(counts)))
    out = {
        "summary": reports.pitcher_summary(rows, ["Pitcher"]),
        "hand": rows.groupBy("Pitcher").agg(reports.typical("PitcherThrows").alias("hand")),
        "arsenal": reports.arsenal(part, ["Pitcher"]).orderBy(F.desc("n"), "TaggedPitchType"),
        "movement": reports.movement(rows, ["Pitcher"]),
        "velocity": surfaces.velocity_density(rows, ["Pitcher"]),
        "density": surfaces.pitch_density(part, ["Pitcher"]),
        "surfaces": surfaces.surfaces(part, ["Pitcher"], PITCHER_SURFACES),
        "located": surfaces.located_count(part, ["Pitcher"]),
    }
    if pool is not None:
        out["percentiles"] = serving.percentile_ranks(pool).join(rows.select("Pitcher").distinct(), "Pitcher", "left_semi")
    return out


def batter_report(rows: DataFrame, versus: str | None = None, family: str = "All") -> dict[str, DataFrame]:
    return {
        "summary": reports.batter_summary(rows, ["Batter"]),
        "bats": reports.bats(rows, ["Batter"]),
        "families": reports.family_table(rows, ["Batter"], versus),
        "spray": reports.spray(rows),
        "launch": surfaces.launch_histogram(rows, ["Batter"]),
        "surfaces": surfaces.surfaces(rows, ["Batter"], BATTER_SURFACES, family),
    }


def season_events(pitches: DataFrame, level: str, year: str) -> DataFrame:
    """Rows a model learns from: the pooled level by league over all parts, D1 by its part, others by level."""
    rows = pitches.where(F.col("file_year") == year)
    if level == POOLED_LEVEL:
        return rows.where(F.col("League").isin(POOLED_LEAGUES))
    return rows.where(F.col("part") == "D1") if level == "D1" else rows.where((F.col("part") == "Others") & (F.col("Level") == level))


def training_frame(pitches: DataFrame, matrix: DataFrame, level: str, year: str) -> DataFrame:
    """Batted balls of a season with their run deltas. The slice must hold each state once, or the join would fan out."""
    cells = runs.re_slice(matrix, level, year)
    if not cells.groupBy("re288_state").count().where("count > 1").isEmpty():
        raise ValueError(f"{level} {year}: a state has more than one expectancy")
    return runs.batted_balls(runs.run_delta(season_events(pitches, level, year), cells))


def train(pitches: DataFrame, matrix: DataFrame, level: str, year: str, root: str, k: int | None = None, alpha: float | None = None) -> knn.Model:
    """Fits and stores the model of a level and year; without k and alpha they are the defaults."""
    batted = training_frame(pitches, matrix, level, year)
    weights = [r["weight"] for r in runs.linear_weights(batted).orderBy("place").collect()]
    model = knn.fit(batted, weights, k or knn.DEFAULT_K, alpha if alpha is not None else knn.DEFAULT_ALPHA)
    knn.save(batted.sparkSession, model, f"{root}/{level}/{year}")
    return model


def available(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Level -> years that have a stored model."""
    tree = Tree(spark, root)
    return {level: tree.children(f"{root}/{level}") for level in tree.children(root)}


def export_rows(pitches: DataFrame, assigned: DataFrame, names: DataFrame) -> DataFrame:
    """A player's full rows with the cluster label as their last column."""
    return serving.cluster_view(pitches, assigned, names, into="ClusterTag").drop("ClusterConf")


def retag_counts(overrides: DataFrame, pitcher: str | None = None) -> DataFrame:
    rows = overrides if pitcher is None else overrides.where(F.col("pitcher") == pitcher)
    return rows.groupBy("pitcher").agg(F.count("*").alias("pitches"))


def cluster_counts(assigned: DataFrame, names: DataFrame) -> DataFrame:
    labelled = assigned.join(F.broadcast(names), "cluster", "left")
    return labelled.groupBy("cluster", serving.cluster_names(names).alias("label")).agg(F.count("*").alias("n"))


def refreshed(table: DataFrame, path: str) -> DataFrame:
    """A stored table (index, pool) made anew; readers that come later see the new files."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)
