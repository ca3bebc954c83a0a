"""Picker index, scopes, search, player rows, overlays, percentile pool."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import FASTBALLS, PERCENTILE_METRICS, POOLED_LEAGUES, POOLED_LEVEL, QUALIFYING_OUTS
from .reports import call, is_any, tally
from .reports import located as is_located
from .surfaces import out_of_zone

ALL = "All"
UNCLUSTERED = "Unclustered"
ROLES = {"pitcher": ("Pitcher", "PitcherTeam"), "batter": ("Batter", "BatterTeam")}
#: Columns that a player's rows are read with, by role.
ROLE_COLUMNS = {
    "pitcher": [
        "Pitcher", "PitcherId", "PitcherTeam", "PitchUID", "Date", "Level", "League", "part", "file_year", "PitchofPA", "Balls",
        "Strikes", "BatterSide", "PitcherThrows", "TaggedPitchType", "AutoPitchType", "PitchCall", "KorBB", "PlayResult",
        "PlateLocHeight", "PlateLocSide", "ExitSpeed", "Angle", "Direction", "OutsOnPlay", "RelSpeed", "SpinRate", "SpinAxis",
        "RelHeight", "RelSide", "Extension", "InducedVertBreak", "HorzBreak",
    ],
    "batter": [
        "Batter", "BatterId", "BatterTeam", "PitchUID", "Date", "Level", "League", "part", "file_year", "PitchofPA", "Balls",
        "Strikes", "BatterSide", "PitcherThrows", "TaggedPitchType", "AutoPitchType", "PitchCall", "KorBB", "PlayResult",
        "PlateLocHeight", "PlateLocSide", "ExitSpeed", "Angle", "Direction", "Bearing", "Distance",
    ],
}


def level_is(level: str | None) -> Column:
    """All levels, one of them, or the pooled level, which is a set of leagues."""
    if not level or level == ALL:
        return F.lit(True)
    return F.col("League").isin(POOLED_LEAGUES) if level == POOLED_LEVEL else F.col("Level") == level


def year_in(years: list[str] | None) -> Column:
    """Date prefixes, a form that the Parquet scan can use."""
    return reduce(lambda a, b: a | b, [F.col("Date").startswith(y) for y in years]) if years else F.lit(True)


def picker_index(pitches: DataFrame, role: str, with_files: bool = False) -> DataFrame:
    """Distinct selections of a role; ``with_files`` adds the year that files are kept under, which may differ."""
    player, team = ROLES[role]
    files = [F.col("file_year").alias("FileYear")] if with_files else []
    known = pitches.where(F.col(player).isNotNull() & (F.length("Date") >= 4))
    return known.select(F.col("part").alias("Part"), "Level", "League", F.col(team).alias("Team"), F.col(player).alias("Player"), F.substring("Date", 1, 4).alias("Year"), *files).distinct()


def with_conference(index: DataFrame, teams: DataFrame) -> DataFrame:
    """``teams``: acronym, conference; a fixed dimension of a few hundred rows."""
    return index.join(F.broadcast(teams.select(F.col("acronym").alias("Team"), F.col("conference").alias("Conference"))), "Team", "left")


INDEX = ["Part", "Level", "League", "Team", "Player", "Year"]


def load_index(pitches: DataFrame, role: str, path: str, teams: DataFrame, rebuild: bool = False) -> DataFrame:
    """The stored index of a role with conferences; made, or made anew where it lacks a column or ``rebuild`` asks."""
    spark = pitches.sparkSession
    try:
        held = None if rebuild else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    if held is None or not set(INDEX) <= set(held.columns):
        write_index(picker_index(pitches, role), path)
        held = spark.read.parquet(path)
    return with_conference(held, teams)


def index_stats(index: DataFrame) -> DataFrame:
    """Rows and distinct players, teams, levels; a null counts as a value."""
    distinct = lambda c: F.countDistinct(c) + F.when(F.count_if(F.col(c).isNull()) > 0, 1).otherwise(0)
    return index.agg(F.count("*").alias("combos"), *[distinct(c).alias(n) for c, n in (("Player", "players"), ("Team", "teams"), ("Level", "levels"))])


def levels(index: DataFrame) -> list[str]:
    """Level names in order, the pooled one after D1 where any of its leagues occurs."""
    found = [r[0] for r in index.where("Level IS NOT NULL").select("Level").distinct().orderBy("Level").collect()]
    if not index.where(F.col("League").isin(POOLED_LEAGUES)).isEmpty():
        found.insert(found.index("D1") + 1 if "D1" in found else 0, POOLED_LEVEL)
    return found


def scope(index: DataFrame, years: list[str] | None = None, level: str = ALL, conference: str = ALL, team: str = ALL, depth: int = 3) -> DataFrame:
    """The index cut by years and by the first ``depth`` of level, conference, team."""
    out = index.where(F.col("Year").isin(years)) if years else index
    cuts = [level_is(level), F.col("Conference") == conference if conference != ALL else F.lit(True), F.col("Team") == team if team != ALL else F.lit(True)]
    for cut in cuts[:depth]:
        out = out.where(cut)
    return out


def options(index: DataFrame, column: str, descending: bool = False) -> DataFrame:
    order = F.desc(column) if descending else F.asc(column)
    return index.where(F.col(column).isNotNull()).select(column).distinct().orderBy(order)


def team_label(teams: DataFrame) -> DataFrame:
    """acronym -> label: its name, or the acronym where the name is unsure (starts with ?) or absent."""
    name = F.col("team_name")
    return teams.select("acronym", F.when(name.isNull() | (name == "") | name.startswith("?"), F.col("acronym")).otherwise(name).alias("label"))


def team_options(index: DataFrame, teams: DataFrame) -> DataFrame:
    found = options(index, "Team").withColumnRenamed("Team", "acronym").join(F.broadcast(team_label(teams)), "acronym", "left")
    labelled = found.select("acronym", F.coalesce("label", "acronym").alias("label"))
    return labelled.orderBy(F.lower("label"), "acronym")


def search_players(indexes: dict[str, DataFrame], teams: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Players of both roles whose name and school hold every word of the query; the limit is the feature."""
    words = query.lower().split()
    names = F.broadcast(team_label(teams).withColumnRenamed("acronym", "Team"))
    parts = []
    for place, role in enumerate(ROLES):
        rows = indexes[role].select("Player", "Team").distinct().join(names, "Team", "left")
        text = F.lower(F.concat_ws(" ", F.coalesce("Player", F.lit("")), F.coalesce("label", F.lit(""))))
        met = reduce(lambda a, b: a & b, [text.contains(w) for w in words], F.lit(bool(words)))
        hits = rows.where(met).orderBy("Player", "Team").limit(limit)
        parts.append(hits.select(F.lit(place).alias("place"), F.trim("Player").alias("name"), F.lit(role).alias("role"), F.coalesce("label", "Team").alias("school")))
    return parts[0].unionByName(parts[1]).orderBy("place", "name", "school").limit(limit).drop("place")


def player_rows(pitches: DataFrame, index: DataFrame, role: str, player: str, level: str = ALL, team: str = ALL, years: list[str] | None = None) -> DataFrame:
    """A player's rows with the role's columns. The index names the partitions to read: a literal filter on partition
    columns, which the scan prunes on."""
    name, team_column = ROLES[role]
    held = index.where((F.col("Player") == player) & level_is(level))
    held = held.where(F.col("Team") == team) if team != ALL else held
    held = held.where(F.col("Year").isin(years)) if years else held
    parts = [tuple(r) for r in held.select("Part", "FileYear").distinct().collect()]
    pruned = reduce(lambda a, b: a | b, [(F.col("part") == p) & (F.col("file_year") == y) for p, y in parts], F.lit(False))
    rows = pitches.where(pruned & (F.col(name) == player) & level_is(level) & year_in(years))
    rows = rows.where(F.col(team_column) == team) if team != ALL else rows
    return rows.select(*ROLE_COLUMNS[role], F.substring("Date", 1, 4).alias("Year"))


def rows_of(pitches: DataFrame, index: DataFrame, role: str, player: str, level: str | None = None, team: str | None = None, years: list[str] | None = None) -> DataFrame:
    """``player_rows`` for values as they are picked: nothing picked means all, and years count once, in order."""
    return player_rows(pitches, index, role, player, level or ALL, team or ALL, sorted(set(years or ())) or None)


# Overlays: tables of (PitchUID, ...) with an ingest number; the latest row of a pitch counts ---------


def latest(changes: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return changes.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def retags(changes: DataFrame) -> DataFrame:
    """Live overrides (PitchUID, tag, pitcher): the last change of a pitch, unless it clears it. A change without a
    pitch clears its pitcher's earlier ones."""
    cleared = changes.where("PitchUID IS NULL").groupBy("pitcher").agg(F.max("seq").alias("cleared"))
    last = latest(changes.where("PitchUID IS NOT NULL"), ["PitchUID"]).join(cleared, "pitcher", "left")
    return last.where("tag IS NOT NULL AND (cleared IS NULL OR seq > cleared)").select("PitchUID", "tag", "pitcher")


def apply_retags(pitches: DataFrame, overrides: DataFrame) -> DataFrame:
    joined = pitches.join(overrides.select("PitchUID", "tag"), "PitchUID", "left")
    return joined.withColumn("TaggedPitchType", F.coalesce("tag", "TaggedPitchType")).drop("tag").select(*pitches.columns)


def cluster_names(names: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))


def cluster_view(pitches: DataFrame, assigned: DataFrame, names: DataFrame, into: str = "TaggedPitchType") -> DataFrame:
    """``into`` holds cluster labels; ``assigned`` is (PitchUID, cluster, conf), ``names`` (cluster, name)."""
    labelled = assigned.join(F.broadcast(names), "cluster", "left").select("PitchUID", cluster_names(names).alias("_label"), F.col("conf").alias("ClusterConf"))
    joined = pitches.join(labelled, "PitchUID", "left").withColumn(into, F.coalesce("_label", F.lit(UNCLUSTERED))).drop("_label")
    return joined.select(*dict.fromkeys([*pitches.columns, into, "ClusterConf"]))


def unsure(pitches: DataFrame, assigned: DataFrame, reviewed: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pitches of low confidence that no one has reviewed, least sure first."""
    low = assigned.where(F.col("conf") < threshold).join(reviewed.select("PitchUID"), "PitchUID", "left_anti")
    rows = pitches.select("PitchUID", "RelSpeed", "SpinRate", "InducedVertBreak", "HorzBreak")
    return rows.join(low, "PitchUID").orderBy("conf", "PitchUID")


def hand_assigned(assigned: DataFrame, changes: DataFrame) -> DataFrame:
    """Assignments after review: a reviewed pitch has the reviewer's cluster, with confidence 1."""
    placed = latest(changes, ["PitchUID"]).select("PitchUID", F.col("cluster").alias("_to"))
    joined = assigned.join(placed, "PitchUID", "full_outer")
    return joined.select("PitchUID", F.coalesce("_to", "cluster").alias("cluster"), F.when(F.col("_to").isNotNull(), 1.0).otherwise(F.col("conf")).alias("conf"))


AUTO = "Auto"


def environment(choice: str | None) -> str | None:
    """A picked run environment; the automatic one leaves it to each ball."""
    return None if choice in (None, "", AUTO) else choice


def model_key(level_override: str | None, year_override: str | None, selected: str | None) -> list[Column]:
    """Which model scores a ball: the chosen one, else the pooled one where that is selected, else its own."""
    level_override, year_override = environment(level_override), environment(year_override)
    level = F.lit(level_override) if level_override else F.lit(POOLED_LEVEL) if selected == POOLED_LEVEL else F.col("Level")
    year = F.lit(year_override) if year_override else F.substring("Date", 1, 4)
    return [level.alias("model_level"), year.alias("model_year")]


# Percentiles -------------------------------------------------------------------------------------


def barrel() -> Column:
    over = F.col("ExitSpeed") - 98
    high, low = F.least(F.lit(50.0), 30 + over * 20.0 / 18.0), F.greatest(F.lit(8.0), 26 - over)
    return call("InPlay") & (F.col("ExitSpeed") >= 98) & F.col("Angle").isNotNull() & (F.col("Angle") >= low) & (F.col("Angle") <= high)


def percentile_pool(pitches: DataFrame, level: str = ALL, years: list[str] | None = None) -> DataFrame:
    """Per-pitcher counts and rates of a level and years: one pass, one exchange of partial sums."""
    swing = is_any("PitchCall", ["StrikeSwinging", "FoulBallNotFieldable", "FoulBallFieldable", "InPlay"])
    struck = F.when(call("InPlay"), F.col("ExitSpeed"))
    bip = call("InPlay") & is_any("TaggedHitType", ["GroundBall", "FlyBall", "LineDrive", "Popup"])
    outside = is_located() & out_of_zone()
    rows = pitches.where(F.col("Pitcher").isNotNull() & level_is(level) & year_in(years))
    sums = rows.groupBy("Pitcher").agg(
        F.count("*").alias("n_pitches"), tally(F.col("PitchofPA") == 1).alias("bf"), tally(F.col("KorBB") == "Strikeout").alias("k"),
        tally(F.col("KorBB") == "Walk").alias("bb"), F.coalesce(F.sum("OutsOnPlay"), F.lit(0)).alias("on_play"),
        F.avg(F.when(is_any("TaggedPitchType", FASTBALLS), F.col("RelSpeed"))).alias("fb_velo"), F.avg("Extension").alias("ext"), F.avg(struck).alias("avg_ev"),
        F.try_divide(tally(struck >= 95), F.count(struck)).alias("hardhit"), F.try_divide(tally(barrel()), F.count(struck)).alias("barrel"),
        F.try_divide(tally(call("InPlay") & (F.col("TaggedHitType") == "GroundBall")), tally(bip)).alias("gb"),
        F.try_divide(tally(call("StrikeSwinging")), tally(swing)).alias("whiff"), F.try_divide(tally(outside & swing), tally(outside)).alias("chase"),
    )
    outs = F.col("on_play") + F.col("k")
    return sums.withColumns(
        {"outs": outs, "k_pct": F.try_divide("k", "bf"), "bb_pct": F.try_divide("bb", "bf"), "qualified": outs >= QUALIFYING_OUTS}
    ).drop("on_play")


def percentile_ranks(pool: DataFrame, least: int = 10) -> DataFrame:
    """Mid-rank percentiles of every pitcher against the qualified ones, better is higher, within 1 and 99.4.

    Values and qualified references are sorted together a metric at a time: running counts, no pairs.
    """
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).alias("value")) for m, up in PERCENTILE_METRICS])
    long = pool.select("Pitcher", "qualified", F.explode(metrics).alias("m")).select("Pitcher", "qualified", "m.*").where("value IS NOT NULL")
    at = long.groupBy("metric", "up", "value").agg(F.count_if("qualified").alias("ties"))
    below = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("metric")
    placed = at.withColumns({"under": F.coalesce(F.sum("ties").over(below), F.lit(0)), "refs": F.sum("ties").over(whole)})
    p = 100 * (F.col("under") + 0.5 * F.col("ties")) / F.nullif(F.col("refs"), F.lit(0))
    good = F.when(F.col("up"), p).otherwise(100 - p)
    scored = placed.select("metric", "value", F.when(F.col("refs") >= least, F.least(F.greatest(good, F.lit(1.0)), F.lit(99.4))).alias("percentile"))
    return long.select("Pitcher", "metric", "value").join(scored, ["metric", "value"])


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
