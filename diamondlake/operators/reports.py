"""Pitcher and batter reports. Every table is one aggregate of conditional sums; numbers stay numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUTO_NAMES, FAMILIES, HARD_HIT, HITS, NOT_PITCHES, PITCH_NAMES, STRIKES, SUB_NAMES, SWINGS, ZONE_BOTTOM, ZONE_HALF, ZONE_TOP


def tally(condition: Column) -> Column:
    """Rows for which the condition is true, 0 where there are none."""
    return F.count(F.when(condition, 1))


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(condition.cast("double"))


def is_any(column: str, values) -> Column:
    return F.col(column).isin(list(values))


def call(value: str) -> Column:
    return F.col("PitchCall") == value


def located() -> Column:
    return F.col("PlateLocSide").isNotNull() & F.col("PlateLocHeight").isNotNull()


def in_zone() -> Column:
    return located() & (F.abs("PlateLocSide") <= ZONE_HALF) & F.col("PlateLocHeight").between(ZONE_BOTTOM, ZONE_TOP)


def lookup(values: dict[str, str], column: Column) -> Column:
    """The mapped value, or null."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.when(column.isNotNull(), F.try_element_at(pairs, column))


# Pitcher -----------------------------------------------------------------------------------------


def pitcher_summary(pitches: DataFrame, keys: list[str]) -> DataFrame:
    line = pitches.groupBy(*keys).agg(
        F.count("*").alias("pitches"),
        tally(F.col("PitchofPA") == 1).alias("batters_faced"),
        tally(F.col("KorBB") == "Strikeout").alias("strikeouts"),
        tally(F.col("KorBB") == "Walk").alias("walks"),
        tally(call("HitByPitch")).alias("hit_batters"),
        tally(is_any("PlayResult", HITS)).alias("hits"),
        F.coalesce(F.sum("OutsOnPlay"), F.lit(0)).alias("outs_on_play"),
        tally(is_any("PlayResult", ["Out", "Sacrifice"])).alias("retired_in_play"),
        *[F.avg(c).alias(n) for c, n in (("RelHeight", "rel_height"), ("RelSide", "rel_side"), ("Extension", "extension"), ("xRV", "xrv"))],
    )
    outs = F.col("outs_on_play") + F.col("strikeouts")
    return line.select(
        *keys, "pitches", "batters_faced", "strikeouts", (F.col("walks") + F.col("hit_batters")).alias("free_passes"), "hits",
        outs.alias("outs"), F.expr("(outs_on_play + strikeouts) div 3").alias("innings"), (outs % 3).alias("innings_rest"),
        (F.col("strikeouts") + F.col("retired_in_play")).alias("retired"), "rel_height", "rel_side", "extension", "xrv",
        F.try_divide("pitches", "batters_faced").alias("pitches_per_pa"),
        F.try_divide("strikeouts", "batters_faced").alias("k_rate"), F.try_divide("walks", "batters_faced").alias("bb_rate"),
    )


def mean_direction(column: str) -> Column:
    """Circular mean in degrees, 0 to 360."""
    turn = F.radians(column)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn)))), F.lit(360.0))


def arsenal(pitches: DataFrame, keys: list[str]) -> DataFrame:
    """One row a tagged pitch type. Usage is of all pitches of the key, whatever their tag; hard hits and exit speed
    are of every tracked ball, in play or not."""
    from pyspark.sql.window import Window

    kinds = pitches.groupBy(*keys, "TaggedPitchType").agg(
        F.count("*").alias("n"), F.avg("RelSpeed").alias("velo"), F.max("RelSpeed").alias("velo_max"), F.avg("SpinRate").alias("spin"),
        share(is_any("PitchCall", STRIKES)).alias("strike_rate"), tally(call("StrikeSwinging")).alias("whiffs"),
        tally(is_any("PitchCall", SWINGS)).alias("swings"), F.avg("InducedVertBreak").alias("vert_break"), F.avg("HorzBreak").alias("horz_break"),
        mean_direction("SpinAxis").alias("spin_axis"), F.avg("RelHeight").alias("rel_height"), F.avg("RelSide").alias("rel_side"),
        F.avg("Extension").alias("extension"), F.avg("ExitSpeed").alias("exit_speed"),
        share(F.col("ExitSpeed") >= HARD_HIT).alias("hard_hit"), F.avg("xRV").alias("xrv"),
    )
    used = kinds.withColumn("usage", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return used.where(F.col("TaggedPitchType").isNotNull() & ~is_any("TaggedPitchType", NOT_PITCHES)).withColumn("whiff_rate", F.try_divide("whiffs", "swings"))


def spin_clock(axis: Column) -> Column:
    """Spin axis as a clock face, to the quarter hour: 180 degrees is 12:00."""
    quarters = F.pmod(F.bround(F.pmod((axis - 180) / 30, F.lit(12.0)) * 4), F.lit(48)).cast("int")
    hour = F.floor(quarters / 4)
    return F.format_string("%d:%02d", F.when(hour == 0, 12).otherwise(hour), quarters % 4 * 15)


def typical(column: str) -> Column:
    """Commonest value, the lowest on a tie."""
    return F.mode(column, True)


def hand_split(hands: list[str]) -> Column:
    """LHH or RHH alone; none or both is everyone."""
    return F.lit(True) if len(hands) != 1 else F.col("BatterSide") == {"LHH": "Left", "RHH": "Right"}[hands[0]]


def count_split(chosen: list[str]) -> Column:
    """Any of the named situations and exact counts ("2-1"); none is every count."""
    balls, strikes = F.col("Balls"), F.col("Strikes")
    situations = {
        "First pitch": (balls == 0) & (strikes == 0),
        "Ahead": strikes > balls,
        "Behind": balls > strikes,
        "Even": balls == strikes,
        "2-strike": strikes == 2,
        "3-ball": balls == 3,
    }
    exact = F.concat(balls.cast("string"), F.lit("-"), strikes.cast("string"))
    return reduce(lambda a, b: a | b, [situations.get(c, exact == c) for c in chosen]) if chosen else F.lit(True)


def movement(pitches: DataFrame, keys: list[str]) -> DataFrame:
    """Movement of tagged pitches, with the rank of each type by frequency."""
    tagged = pitches.where(F.col("TaggedPitchType").isNotNull() & ~is_any("TaggedPitchType", NOT_PITCHES) & F.col("HorzBreak").isNotNull() & F.col("InducedVertBreak").isNotNull())
    from pyspark.sql.window import Window

    sizes = tagged.groupBy(*keys, "TaggedPitchType").agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "TaggedPitchType")))
    return tagged.select(*keys, "PitchUID", "TaggedPitchType", "HorzBreak", "InducedVertBreak").join(F.broadcast(ranked) if not keys else ranked, [*keys, "TaggedPitchType"])


# Batter ------------------------------------------------------------------------------------------


def batter_summary(pitches: DataFrame, keys: list[str]) -> DataFrame:
    struck = call("InPlay") & F.col("ExitSpeed").isNotNull()
    line = pitches.groupBy(*keys).agg(
        tally(F.col("PitchofPA") == 1).alias("pa"),
        *[tally(F.col("PlayResult") == r).alias(n) for r, n in (("Single", "b1"), ("Double", "b2"), ("Triple", "b3"), ("HomeRun", "hr"), ("Sacrifice", "sac"))],
        tally(F.col("KorBB") == "Walk").alias("bb"), tally(F.col("KorBB") == "Strikeout").alias("so"), tally(call("HitByPitch")).alias("hbp"),
        F.avg(F.when(struck, F.col("ExitSpeed"))).alias("exit_speed"), share(F.when(struck, F.col("ExitSpeed") >= HARD_HIT)).alias("hard_hit"),
        F.avg(F.when(call("InPlay"), F.col("Angle"))).alias("launch_angle"), F.avg("xRV").alias("xrv"),
    )
    c = F.col
    counted = line.withColumns({"h": c("b1") + c("b2") + c("b3") + c("hr"), "ab": c("pa") - c("bb") - c("hbp") - c("sac")})
    reached, chances = c("h") + c("bb") + c("hbp"), c("ab") + c("bb") + c("hbp") + c("sac")
    bases = c("b1") + 2 * c("b2") + 3 * c("b3") + 4 * c("hr")
    rated = counted.withColumns(
        {
            "avg": F.try_divide(c("h"), c("ab")),
            "obp": F.try_divide(reached, chances),
            "slg": F.try_divide(bases, c("ab")),
            "k_rate": F.try_divide(c("so"), c("pa")),
            "bb_rate": F.try_divide(c("bb"), c("pa")),
        }
    )
    return rated.withColumn("ops", c("obp") + c("slg")).drop("b1", "sac")


def bats(pitches: DataFrame, keys: list[str]) -> DataFrame:
    """L, R, or S where the rarer side has a fifth; L on a tie, and where sides are known but neither; else blank."""
    sides = pitches.groupBy(*keys).agg(
        F.count("BatterSide").alias("known"), tally(F.col("BatterSide") == "Left").alias("left"), tally(F.col("BatterSide") == "Right").alias("right")
    )
    both = F.col("left") + F.col("right")
    switch = F.coalesce(F.try_divide(F.least("left", "right"), both) >= 0.2, F.lit(False))
    side = F.when(F.col("known") == 0, "").when(switch, "S").when(F.col("left") >= F.col("right"), "L").otherwise("R")
    return sides.select(*keys, "left", "right", side.alias("bats"))


_FAMILY_OF = {t: f for f, types in FAMILIES.items() for t in types}


def effective_type() -> Column:
    """The tag, or where that belongs to no family the automatic type under its tag name."""
    auto = F.coalesce(lookup(AUTO_NAMES, F.col("AutoPitchType")), F.col("AutoPitchType"))
    return F.when(lookup(_FAMILY_OF, F.col("TaggedPitchType")).isNotNull(), F.col("TaggedPitchType")).otherwise(auto)


def family(kind: Column) -> Column:
    return F.coalesce(lookup(_FAMILY_OF, kind), F.lit("Others"))


COMPONENTS = ("n", "swings", "whiffs", "located", "good", "zone", "zone_swings", "zone_whiffs", "out", "out_swings", "tracked", "hard", "speed_sum", "xrv_n", "xrv_sum")


def _components() -> list[Column]:
    swing = F.coalesce(is_any("PitchCall", SWINGS), F.lit(False))
    whiff, play = call("StrikeSwinging"), call("InPlay")
    known = is_any("PitchCall", SWINGS)
    inside = F.coalesce(in_zone(), F.lit(False))
    outside = located() & ~inside
    good = (inside & known) | (outside & ~known)
    return [
        F.count("*").alias("n"), tally(swing).alias("swings"), tally(whiff).alias("whiffs"), tally(located()).alias("located"),
        tally(good).alias("good"), tally(inside).alias("zone"), tally(inside & swing).alias("zone_swings"), tally(inside & whiff).alias("zone_whiffs"),
        tally(outside).alias("out"), tally(outside & swing).alias("out_swings"), tally(play & F.col("ExitSpeed").isNotNull()).alias("tracked"),
        tally(play & (F.col("ExitSpeed") >= HARD_HIT)).alias("hard"), F.coalesce(F.sum(F.when(play, F.col("ExitSpeed"))), F.lit(0.0)).alias("speed_sum"),
        F.count("xRV").alias("xrv_n"), F.coalesce(F.sum("xRV"), F.lit(0.0)).alias("xrv_sum"),
    ]


def family_components(pitches: DataFrame, keys: list[str], versus: str | None = None) -> DataFrame:
    """Counts and sums by family and sub-type; ``versus`` keeps pitchers of one hand."""
    kind = effective_type()
    rows = pitches.where(F.col("PitcherThrows") == versus) if versus in ("Left", "Right") else pitches
    named = rows.withColumns({"family": family(kind), "sub": F.coalesce(lookup(SUB_NAMES, kind), kind)})
    return named.groupBy(*keys, "family", "sub").agg(*_components())


def family_table(pitches: DataFrame, keys: list[str], versus: str | None = None) -> DataFrame:
    """All pitches, each family, and each sub-type, with rates: level 0, 1, 2. Sums of the components, so the totals
    cost no second pass over pitches."""
    parts = family_components(pitches, keys, versus).withColumn("sub", F.coalesce("sub", F.lit("?")))
    both = F.array(F.struct(F.lit(0).alias("level"), F.lit("All").alias("family"), F.lit(None).cast("string").alias("sub")),
                   F.struct(F.lit(1).alias("level"), F.col("family"), F.lit(None).cast("string").alias("sub")),
                   F.struct(F.lit(2).alias("level"), F.col("family"), F.col("sub")))
    spread = parts.withColumn("x", F.explode(both)).select(*keys, "x.level", "x.family", "x.sub", *COMPONENTS)
    sums = spread.groupBy(*keys, "level", "family", "sub").agg(*[F.sum(c).alias(c) for c in COMPONENTS])
    ratio = F.try_divide
    rates = {
        "swing_rate": ratio("swings", "n"),
        "contact_rate": ratio(F.col("swings") - F.col("whiffs"), F.col("swings")),
        "good_rate": ratio("good", "located"),
        "whiff_rate": ratio("whiffs", "swings"),
        "zone_swing_rate": ratio("zone_swings", "zone"),
        "zone_whiff_rate": ratio("zone_whiffs", "zone_swings"),
        "chase_rate": ratio("out_swings", "out"),
        "hard_hit": ratio("hard", "tracked"),
        "exit_speed": ratio("speed_sum", "tracked"),
        "xrv": ratio("xrv_sum", "xrv_n"),
    }
    return sums.select(*keys, "level", "family", "sub", "n", *[v.alias(k) for k, v in rates.items()])


def spray(pitches: DataFrame, points: int = 18) -> DataFrame:
    """Paths of balls in play as quadratic curves: out along Direction, down at Bearing and Distance."""
    flown = pitches.where(call("InPlay") & F.col("Direction").isNotNull() & F.col("Bearing").isNotNull() & F.col("Distance").isNotNull() & is_any("PlayResult", ["Out", *HITS]))
    t = F.col("i") / (points - 1)

    def along(turn) -> Column:
        start, end = 0.5 * F.col("Distance") * turn(F.radians("Direction")), F.col("Distance") * turn(F.radians("Bearing"))
        return 2 * (1 - t) * t * start + t * t * end

    spread = flown.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return spread.select("PitchUID", "Batter", "PlayResult", "i", along(F.sin).alias("x"), along(F.cos).alias("y"))


def display_name(tag: Column) -> Column:
    """A tag as a pitcher's report shows it."""
    names = F.create_map(*[F.lit(x) for kv in PITCH_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, tag), tag)
