"""Driver queries: each applies operators to whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapter import pitches
from ..operators import bio, eye, fold, gmm, knn, reports, runs, scouting, serving, surfaces
from ..sources import ingest, layout
from ..sources.shared import written

LEVEL, YEAR = "D1", "1995"
NUDGE = 1e-9
#: Decisions that a batter needs for the leaderboard.
LEAST_SCORED = 300
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show (the nudge keeps exact halves off the edge); counts
    as long."""
    kinds = {"double": lambda c: F.round(c + NUDGE, digits) + F.lit(0.0), "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*[kinds.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: settled(f(spark, sf_dir))
    return f


def over_pitches(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: settled(f(pitches(spark, sf_dir)))
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def season(p: DataFrame) -> DataFrame:
    return p.where((F.col("Level") == LEVEL) & (F.col("file_year") == YEAR))


# Runs ---------------------------------------------------------------------------------------------


@over_pitches
def re_matrix(p):
    return runs.final_matrix(p)


@over_pitches
def re_matrix_pooled_level(p):
    return runs.re_matrix(p).where(F.col("Level") == "P4")


@over_pitches
def re_matrix_extra_innings(p):
    """What innings from the tenth on add, which only D1 keeps."""
    late = p.where(F.col("Inning") >= runs.EXTRA_INNING)
    return runs.re_matrix(late)


def _delta(p):
    return runs.run_delta(season(p), runs.re_slice(runs.re_matrix(p), LEVEL, YEAR))


@over_pitches
def run_delta(p):
    return _delta(p).select("PitchUID", "re288_state", "re_now", "run_delta")


@over_pitches
def linear_weights(p):
    return runs.linear_weights(runs.batted_balls(_delta(p)))


@over_pitches
def run_value_by_count(p):
    kept = season(runs.runs_to_end(p)).drop("runs_left")
    valued = runs.run_delta(kept, runs.re_slice(runs.re_matrix(p), LEVEL, YEAR), game="GameUID")
    return valued.groupBy("Balls", "Strikes").agg(F.count("run_delta").alias("n"), F.avg("run_delta").alias("run_value"))


@over_pitches
def count_run_values(p):
    return runs.count_run_values(runs.re_matrix(p).where((F.col("Level") == LEVEL) & (F.col("year") == YEAR)))


@over_pitches
def shrinkage_leaderboard(p):
    return runs.shrunk_scores(p, "Pitcher", "ExitSpeed").where(F.col("n") >= LEAST_SCORED).select("Pitcher", "n", "mean", "per_100")


@over_pitches
def season_correlation(p):
    half = lambda top: p.where(F.col("Top/Bottom") == top).groupBy("Pitcher").agg(F.avg("RelSpeed").alias("v"))
    return runs.correlations(half("Top"), half("Bottom"), "Pitcher", "v")


# State --------------------------------------------------------------------------------------------


@over_pitches
def base_state_fold(p):
    """Only the columns that the fold reads go into its arrays."""
    return fold.annotate(p.select(*fold.READS)).select("PitchUID", "on_1b", "on_2b", "on_3b", "base_state", "re288_state")


@over_pitches
def game_flags(p):
    return fold.game_flags(p)


@query
def postseason_start(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", F.date_format(fold.postseason_start(F.col("year")), "yyyy-MM-dd").alias("start"))


# Reports ------------------------------------------------------------------------------------------


@over_pitches
def pitcher_summary(p):
    return reports.pitcher_summary(p, ["Pitcher"])


@over_pitches
def arsenal(p):
    return reports.arsenal(p, ["Pitcher"]).drop("spin_axis")


@over_pitches
def spin_circular_mean(p):
    return p.groupBy("TaggedPitchType").agg(reports.mean_direction("SpinAxis").alias("spin_axis"))


@over_pitches
def spin_clock(p):
    return p.select("SpinAxis").distinct().select("SpinAxis", reports.spin_clock(F.col("SpinAxis")).alias("clock"))


@over_pitches
def arsenal_split_hand_count(p):
    return reports.arsenal(p.where(reports.hand_split(["LHH"]) & reports.count_split(["2-strike", "1-0"])), ["Pitcher"]).select("Pitcher", "TaggedPitchType", "n", "usage", "velo")


@over_pitches
def throws_mode(p):
    return p.groupBy("Pitcher").agg(reports.typical("PitcherThrows").alias("hand"))


@over_pitches
def movement(p):
    return reports.movement(p, ["Pitcher"])


@over_pitches
def batter_summary(p):
    return reports.batter_summary(p, ["Batter"])


@over_pitches
def bats_side(p):
    return reports.bats(p, ["Batter"])


@over_pitches
def pitch_family_components(p):
    return reports.family_components(p, ["Batter"])


@over_pitches
def pitch_family_table(p):
    return reports.family_table(p, ["BatterTeam"], versus="Right")


@over_pitches
def spray_points(p):
    return reports.spray(p)


@over_pitches
def launch_histogram(p):
    return surfaces.launch_histogram(p, ["BatterTeam"])


@over_pitches
def location_histogram(p):
    whiff = surfaces.populations()["whiff"]
    return surfaces.histogram(p, ["PitcherTeam"], whiff[0], whiff[1])


@over_pitches
def rate_surface_smoothed(p):
    return surfaces.surfaces(p, ["PitcherTeam"], ["whiff"]).select("PitcherTeam", "ix", "iy", "x", "y", "z")


@over_pitches
def batter_surfaces(p):
    return surfaces.surfaces(p, ["BatterTeam"], ["exit_speed", "chase"], "Fastballs")


@over_pitches
def pitch_density_kde(p):
    return surfaces.pitch_density(p, ["Level"])


@over_pitches
def velocity_kde(p):
    return surfaces.velocity_density(p, ["PitcherTeam"])


# Serving ------------------------------------------------------------------------------------------


def _teams(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    return n.select(F.concat(F.lit("T"), key).alias("acronym"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("?"), "n_name")).otherwise(F.col("n_name")).alias("team_name"), F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("conference"))


@over_pitches
def picker_index(p):
    return serving.picker_index(p, "pitcher")


@over_pitches
def index_stats(p):
    return serving.index_stats(serving.picker_index(p, "batter"))


@query
def scope_cascade(spark, sf_dir):
    index = serving.with_conference(serving.picker_index(pitches(spark, sf_dir), "pitcher"), _teams(spark, sf_dir))
    return serving.scope(index, ["1995", "1996"], "P4", "C1", "T1", depth=2)


@query
def team_options(spark, sf_dir):
    return serving.team_options(serving.picker_index(pitches(spark, sf_dir), "pitcher"), _teams(spark, sf_dir))


@query
def player_search(spark, sf_dir):
    p = pitches(spark, sf_dir)
    return serving.search_players({r: serving.picker_index(p, r) for r in serving.ROLES}, _teams(spark, sf_dir), "1 NATION_1", limit=20)


@over_pitches
def level_filter_pooled(p):
    return p.where(serving.level_is("P4")).groupBy("League", "Level").agg(F.count("*").alias("n"))


@over_pitches
def player_rows(p):
    index = serving.picker_index(p, "pitcher", with_files=True)
    return serving.player_rows(p, index, "pitcher", "Supplier#000000001", years=["1995", "1996"]).select("PitchUID", "Year", "TaggedPitchType", "RelSpeed")


@over_pitches
def retag_overlay(p):
    some = p.where(F.col("PitchNo") == 3).select("PitchUID", F.col("Pitcher").alias("pitcher"), (F.length("PitchUID") % 3).alias("m"))
    first = some.select("PitchUID", F.lit("Sweeper").alias("tag"), "pitcher", F.lit(1).alias("seq"))
    second = some.where("m = 1").select("PitchUID", F.lit(None).cast("string").alias("tag"), "pitcher", F.lit(2).alias("seq"))
    return serving.apply_retags(p, serving.retags(first.unionByName(second))).groupBy("TaggedPitchType").agg(F.count("*").alias("n"))


def _assigned(p):
    return p.where(F.col("PitchNo") % 2 == 0).select("PitchUID", (F.col("PitchNo") % 3).cast("int").alias("cluster"), ((F.col("PitchNo") % 10) / 10).alias("conf"))


@over_pitches
def cluster_overlay(p):
    names = p.sparkSession.createDataFrame([(0, "Heater"), (1, None), (2, "")], "cluster int, name string")
    return serving.cluster_view(p, _assigned(p), names).groupBy("TaggedPitchType").agg(F.count("*").alias("n"), F.avg("ClusterConf").alias("conf"))


@over_pitches
def unsure_queue(p):
    reviewed = p.where(F.col("PitchNo") == 4).select("PitchUID")
    return serving.unsure(p, _assigned(p), reviewed)


@over_pitches
def percentile_pool(p):
    return serving.percentile_pool(p, "P4")


@over_pitches
def percentile_ranks(p):
    """Rates are rounded first: equal ones must tie."""
    return serving.percentile_ranks(settled(serving.percentile_pool(p))).select("Pitcher", "metric", "percentile")


# Biography ----------------------------------------------------------------------------------------


@over_pitches
def player_universe(p):
    return bio.universe(p).withColumn("teams", F.array_join("teams", ","))


def _bio_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 < 2")
    key = F.when(F.col("c_custkey") % 23 != 0, F.col("c_custkey").cast("string")).otherwise(F.lit(""))
    status = F.when(F.col("c_custkey") % 4 == 0, "not_found").when(F.col("c_custkey") % 4 == 1, "no_height").otherwise("found")
    one = c.select(F.col("c_name").alias("Name"), key.alias("TrackManId"), (F.col("c_custkey") % 20 + 60).cast("int").alias("HeightIn"), status.alias("Status"), F.col("c_custkey").alias("seq"))
    two = one.where("seq % 7 = 0").select("Name", "TrackManId", (F.col("HeightIn") + 1).alias("HeightIn"), F.lit("manual").alias("Status"), (F.col("seq") + 10_000_000).alias("seq"))
    return one.unionByName(two)


@query
def bio_latest_wins(spark, sf_dir):
    return bio.latest_bio(_bio_table(spark, sf_dir))


@query
def pending_players(spark, sf_dir):
    return bio.pending(bio.universe(pitches(spark, sf_dir)), _bio_table(spark, sf_dir), retry=True, cap=None).select("Name", "TrackManId", "is_d1", "last_seen")


@query
def bio_lookup_fallback(spark, sf_dir):
    players = bio.universe(pitches(spark, sf_dir)).select("Name", F.when(F.length("Name") % 2 == 0, F.lit("x")).otherwise(F.col("TrackManId")).alias("TrackManId")).distinct()
    return bio.bio_lookup(players, _bio_table(spark, sf_dir))


@query
def year_overlap_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Van  Last, C."), F.col("c_custkey").cast("string"))
    players = c.select(name.alias("Name"), F.col("c_custkey").cast("string").alias("TrackManId"), F.when(F.col("c_custkey") % 9 > 0, 1995).alias("first_year"), F.when(F.col("c_custkey") % 9 > 0, 1995 + F.col("c_custkey") % 3).cast("int").alias("last_year"))
    places = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    found = c.select(name.alias("Name"), F.col("c_custkey").cast("string").alias("TrackManId"), "c_custkey", places).where("(c_custkey + i) % 4 <> 0")
    shown = F.when(F.col("i") == 2, F.concat(F.lit("Jr C"), F.col("TrackManId"), F.lit(" Van Last"))).otherwise(F.concat(F.lit("c"), F.col("TrackManId"), F.lit(" VAN Last")))
    start = F.when((F.col("c_custkey") + F.col("i")) % 5 > 0, 1990 + (F.col("c_custkey") * 3 + F.col("i") * 2) % 11).cast("int")
    rows = found.select("Name", "TrackManId", F.col("i").cast("string").alias("url"), shown.alias("cand_name"), start.alias("y0"), (start + F.col("i")).alias("y1"))
    return bio.candidates(players, rows)


@query
def draft_eligibility(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("born")).distinct()
    draft = bio.draft_day(F.year("born") + 21)
    return days.select(F.date_format("born", "yyyy-MM-dd").alias("born"), F.date_format(draft, "yyyy-MM-dd").alias("draft"), bio.age_on(F.col("born"), draft).alias("age"), bio.draft_eligible(F.col("born"), draft).alias("eligible"))


@query
def name_normalise(spark, sf_dir):
    name = F.concat(F.col("s_name"), F.lit(" Jr.,  J. "), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", bio.search_name(name).alias("search"), bio.normal_name(bio.search_name(name)).alias("normal"))


@query
def height_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    page = F.when(key % 3 == 0, F.format_string("<h1>x</h1><span>%d-%d</span>,&nbsp;<span>%dlb</span>", 5 + key % 2, key % 12, 150 + key)).when(key % 3 == 1, F.format_string("<h1>x</h1> (%dcm, 90kg)", 160 + key % 40)).otherwise(F.lit("none"))
    typed = F.when(key % 2 == 0, F.format_string("%d'%d\"", 5 + key % 2, key % 12)).otherwise((key % 100).cast("string"))
    return s.select("s_suppkey", bio.parse_height(page)["inches"].alias("inches"), bio.parse_height(page)["pounds"].alias("pounds"), bio.parse_height_input(typed).alias("typed"))


# Scouting -----------------------------------------------------------------------------------------


def _versions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        (conv * 100 + turn).alias("id"), scouting.player_key(F.when(conv % 2 == 0, (conv % 40).cast("string")), F.concat(F.lit(" Player #"), (conv % 30).cast("string"))).alias("player_key"),
        F.concat(F.lit("P "), (conv % 40).cast("string")).alias("player_name"), F.when(conv % 2 == 0, "pitcher").otherwise("batter").alias("role"), F.lit("School").alias("school"),
        F.concat(F.lit("pos"), (turn % 3).cast("string")).alias("position"), F.when(conv % 5 > 0, 40 + (conv + turn) % 30).cast("int").alias("ovr"), F.concat(F.lit("A"), (conv % 3).cast("string")).alias("author"),
        F.when(conv % 4 > 0, conv % 3).alias("author_id"), F.when((conv % 11 == 0) & (turn > 0), 1).otherwise(0).alias("deleted"), F.format_string("2026-01-%02d", 1 + turn % 28).alias("created_at"),
    )


def _authors(spark):
    return spark.createDataFrame([(0, "Zed"), (1, "amy")], "id long, display_name string")


@query
def latest_threads(spark, sf_dir):
    return scouting.latest_threads(_versions(spark, sf_dir), _authors(spark)).select("player_key", "thread", "id", "ovr", "author_name")


@query
def shortlist_rollup(spark, sf_dir):
    return scouting.shortlist(scouting.latest_threads(_versions(spark, sf_dir), _authors(spark)))


@query
def shortlist_search(spark, sf_dir):
    return scouting.search(scouting.shortlist(scouting.latest_threads(_versions(spark, sf_dir), _authors(spark))), " ZED ")


@query
def thread_history(spark, sf_dir):
    return scouting.history(_versions(spark, sf_dir), "id:2", "a2").select("id", "created_at", "position")


# Ingest -------------------------------------------------------------------------------------------


def _raw(spark, sf_dir):
    """Raw text rows with known faults."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    text = lambda c: c.cast("string")
    return li.select(
        F.concat(F.lit("f"), text(F.col("l_orderkey") % 50), F.lit(".csv")).alias("file_name"),
        F.when(k % 97 == 0, "abc").when(k % 89 == 0, "3.0").otherwise(text(k % 30)).alias("PitchNo"), F.when(k % 301 == 0, "9").otherwise(text(k % 3)).alias("Outs"),
        F.when(k % 401 != 0, text(k % 4)).alias("Balls"), F.when(k % 83 == 0, "1.5d").when(k % 79 == 0, " 88.5 ").otherwise(text(80 + k % 20)).alias("RelSpeed"),
        F.when(k % 71 == 0, "Inplay").when(k % 73 == 0, "PickOff").when(k % 499 == 0, "Bunt?").otherwise("InPlay").alias("PitchCall"), F.when(k % 67 == 0, "StrikeOut").otherwise("Undefined").alias("KorBB"),
        F.lit("gone").alias("Unknown"),
    )


@query
def typed_cast_failures(spark, sf_dir):
    return ingest.cast_failures(_raw(spark, sf_dir))


@query
def value_remap(spark, sf_dir):
    rows = ingest.repaired(ingest.typed(_raw(spark, sf_dir)))
    return rows.groupBy("PitchCall", "KorBB").agg(F.count("*").alias("n"))


def _checked(spark, sf_dir):
    names = ["file_name", "PitchNo", "Outs", "Balls", "RelSpeed", "PitchCall", "KorBB"]
    return ingest.in_ranges(ingest.repaired(ingest.typed(_raw(spark, sf_dir)))).select(*names)


@query
def validation_summary(spark, sf_dir):
    return ingest.failure_summary(ingest.violations(_checked(spark, sf_dir)))


@query
def range_quarantine(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    clean = rows.join(ingest.sound_files(rows), "file_name", "left_semi")
    return clean.groupBy("file_name").agg(F.count("*").alias("n"), F.avg("RelSpeed").alias("speed"))


@query
def missing_column_pad(spark, sf_dir):
    rows = ingest.typed(_raw(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.count("ExitSpeed").alias("exit_speed"), F.count("Notes").alias("notes"), F.lit(len(rows.columns)).alias("width"), F.count("RelSpeed").alias("rel_speed"))


# Models -------------------------------------------------------------------------------------------


def _batted(p):
    return runs.batted_balls(season(p)).select("PitchUID", *knn.FEATURES, "PlayResult")


@over_pitches
def stratified_folds(p):
    return knn.folds(_batted(p)).groupBy("PlayResult", "fold").agg(F.count("*").alias("n"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 5).alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(knn.FEATURES)])


@query
def knn_label_proba(spark, sf_dir):
    """Shares of five labels among the five nearest vectors of each vector, by the kNN kernel on three components."""
    e = _vectors(spark, sf_dir)
    return knn.label_proba(e, e, 5, 0.5)


@over_pitches
def expected_run_values(p):
    """Every ball of the season scored by all balls of the season, however many, with the defaults of the operator."""
    batted = written(runs.batted_balls(_delta(p)).select("PitchUID", "PlayResult", *knn.FEATURES, "run_delta"), "batted")
    weights = [r["weight"] for r in runs.linear_weights(batted).orderBy("place").collect()]
    return knn.expected(batted, weights).select("PitchUID", "PlayResult", "xRV")


@query
def log_loss(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(knn.log_loss((F.col("l_quantity") + 1) / 52).alias("loss"))


@over_pitches
def min_group_count(p):
    return gmm.frequent(p).groupBy("Pitcher").agg(F.count("*").alias("n"))


@over_pitches
def mirror_left(p):
    return gmm.mirrored(p).groupBy("PitcherThrows").agg(F.avg("HorzBreak").alias("break"), F.count("*").alias("n"))


@over_pitches
def gmm_clusters(p):
    """Clusters of every pitcher with 300 complete rows."""
    return gmm.clusters(gmm.eligible(p)).groupBy("Pitcher", "cluster").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"))


@over_pitches
def decision_filter(p):
    return eye.decisions(p).groupBy("family").agg(F.count("*").alias("n"), F.avg("swung").alias("swung"), F.avg("called").alias("called"))


def _valued_decisions(p):
    """Decisions of the season with the run value of each pitch."""
    matrix = runs.re_slice(runs.re_matrix(p), LEVEL, YEAR)
    valued = runs.run_delta(season(p), matrix, game="GameUID").withColumnRenamed("run_delta", "run_value")
    return eye.split(eye.decisions(valued.where("run_value IS NOT NULL")))


@over_pitches
def swing_scores(p):
    """Decision scores by batter, drawn to the mean, by the three models with their defaults."""
    names = ["Batter", "GameUID", "BatterSide", "family", "Balls", "Strikes", "PlateLocHeight", "PlateLocSide", "swung", "called", "run_value", "fold"]
    rows = written(_valued_decisions(p).select(names), "decisions")
    values = runs.count_run_values(runs.re_matrix(p).where((F.col("Level") == LEVEL) & (F.col("year") == YEAR)))
    return runs.shrunk_scores(eye.scored_decisions(rows, values))


@over_pitches
def swing_run_values(p):
    """What the models of a swing's value learn from: mean run value of swings by count and family."""
    rows = _valued_decisions(p).where("swung = 1")
    return rows.groupBy("family", "Balls", "Strikes").agg(F.count("*").alias("n"), F.avg("run_value").alias("run_value"))


@over_pitches
def calibration_bins(p):
    """Called strikes by the height of the pitch, as a stand-in for a model's probability."""
    rows = eye.decisions(p).withColumn("p", F.col("PlateLocHeight") / 5.5)
    return eye.calibration(rows, "p", "called")


# Operators that other queries use or that stand alone -------------------------------------------------


@over_pitches
def level_names(p):
    names = serving.levels(serving.picker_index(p, "pitcher"))
    return p.sparkSession.createDataFrame(list(enumerate(names)), "place long, level string")


@over_pitches
def year_options(p):
    return serving.options(serving.picker_index(p, "batter"), "Year", descending=True)


@query
def conference_options(spark, sf_dir):
    return serving.options(serving.with_conference(serving.picker_index(pitches(spark, sf_dir), "pitcher"), _teams(spark, sf_dir)), "Conference")


@over_pitches
def player_options(p):
    return serving.options(serving.picker_index(p, "batter"), "Player")


@over_pitches
def called_strike_surface(p):
    return surfaces.surfaces(p, ["PitcherTeam"], ["called_strike"]).drop("stat")


@over_pitches
def hard_hit_surface(p):
    return surfaces.surfaces(p, ["PitcherTeam"], ["hard_hit"]).drop("stat")


@over_pitches
def path_level_year(p):
    """Level and year of the files that the pitches lie in."""
    at = layout.path_level_year(F.concat(F.lit("/tree/part="), "part", F.lit("/file_year="), "file_year", F.lit("/month=05/x.parquet")))
    return p.select("part", "file_year", at.alias("at")).distinct().select("part", "file_year", "at.level", "at.year")


@over_pitches
def pitch_display_names(p):
    return p.groupBy("TaggedPitchType").agg(F.count("*").alias("n")).withColumn("shown", reports.display_name(F.col("TaggedPitchType")))


@over_pitches
def plausible_names(p):
    names = p.select(F.col("Pitcher").alias("Name")).distinct()
    both = names.unionByName(names.select(F.concat(F.lit("Last, F"), F.col("Name")).alias("Name")))
    return bio.plausible(both)


@query
def name_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("Name"), F.col("c_custkey").cast("string").alias("TrackManId"), "c_custkey")
    fitting = c.where("c_custkey % 5 < 2").unionByName(c.where("c_custkey % 10 = 0"))
    return bio.resolution(c, fitting)


@query
def report_authors(spark, sf_dir):
    return scouting.report_authors(scouting.latest_threads(_versions(spark, sf_dir), _authors(spark)))


@over_pitches
def hand_assignments(p):
    moved = p.where(F.col("PitchNo") % 6 == 0).select("PitchUID", F.lit(9).alias("cluster"), F.lit(1).alias("seq"))
    return serving.hand_assigned(_assigned(p), moved).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"))


@over_pitches
def cluster_summary(p):
    """Means and sizes of clusters, and the rows that have none, with clusters given by pitch number."""
    found = p.join(_assigned(p), "PitchUID").select("Pitcher", "PitchUID", "cluster")
    left = gmm.unclustered(p, found)
    return gmm.cluster_means(p, found, ["RelSpeed", "HorzBreak"]).join(left, "Pitcher")


@query
def report_ages(spark, sf_dir):
    """Age and eligibility on the draft day of a report's only season."""
    days = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("BirthDate")).distinct()
    return bio.profile(days, [2019], dt.date(2026, 1, 1))


@over_pitches
def attached_run_values(p):
    """Which balls in play a stored model of one level and year scores."""
    from ..operators.knn import Model

    one = Model(np.zeros(3), np.ones(3), np.zeros((1, 3)), np.zeros(1, int), np.arange(5.0), 1, 0.5)
    rows = knn.attach(p, {("D1", YEAR): one}, serving.model_key(None, None, None))
    return rows.groupBy("Level", F.substring("Date", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.count("xRV").alias("scored"), F.max("xRV").alias("xRV"))
