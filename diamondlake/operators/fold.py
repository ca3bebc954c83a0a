"""Base-runner state: a fold of events over each half-inning.

A state is three bits (first base 1, second 2, third 4). An event maps each of the eight states to the next one; the
map depends on a small signature of the pitch, so all maps are one broadcast table of bounded size. Half-innings hold
tens of pitches, so the ordered fold runs in one expression over an array.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DOMAINS, HITS
from .runs import EXTRA_INNING, state_text

STEALS = ["StolenBase", "CaughtStealing"]
MAX_OUTS, MAX_RUNS = 3, 4


def lead_home(state: int, n: int) -> int:
    """The n foremost runners score."""
    for _ in range(n):
        state &= ~(1 << state.bit_length() >> 1)
    return state


def trail_out(state: int, n: int) -> int:
    """The n rearmost runners are out."""
    for _ in range(n):
        state &= state - 1
    return state


def hit(state: int, bases: int, runs: int) -> int:
    far = state << bases | 1 << bases - 1
    return lead_home(far & 7, runs - (far >> 3).bit_count())


def steal(state: int, runs: int) -> int:
    if runs and state & 4:
        return state & 3
    free = state & ~(state >> 1) & 3
    first = free & -free
    return state + first


def next_state(state: int, result: str, walk: str, hit_by_pitch: bool, outs: int, runs: int, guess: bool) -> int:
    """The running event comes first, then the batter's: both can lie on one pitch."""
    going_on = result == walk == "Undefined" and not hit_by_pitch
    if result == "StolenBase":
        state = steal(state, runs)
    elif result == "CaughtStealing":
        state = trail_out(state, 1)
    elif going_on and guess and state:
        state = trail_out(state, 1) if outs else steal(state, runs)
    elif going_on:
        state = lead_home(state, runs)
    if walk == "Walk" or hit_by_pitch:
        return (state | state + 1) & 7
    if walk == "Strikeout":
        return state
    if result in HITS or result == "Error":
        return hit(state, HITS.get(result, 1), runs)
    ended: dict[str, Callable[[], int]] = {
        "Sacrifice": lambda: lead_home(state << 1 & 7, runs - (state >> 2)),
        "FieldersChoice": lambda: lead_home(trail_out(state, max(1, outs)) | 1, runs),
        "Out": lambda: lead_home(trail_out(state, max(0, outs - 1)), runs),
    }
    return ended.get(result, lambda: state)()


def signatures(spark: SparkSession) -> DataFrame:
    """Next states of every signature: results x strikeout/walk x hit by pitch x outs x runs x guess."""
    rows = [
        (r, k, h, o, n, g, [next_state(s, r, k, h, o, n, g) for s in range(8)])
        for r, k, h, o, n, g in itertools.product(
            DOMAINS["PlayResult"], DOMAINS["KorBB"], (False, True), range(MAX_OUTS + 1), range(MAX_RUNS + 1), (False, True)
        )
    ]
    return spark.createDataFrame(rows, "s_result string, s_walk string, s_hbp boolean, s_outs int, s_runs int, s_guess boolean, moves array<int>")


#: Columns that ``annotate`` needs; others are carried along.
READS = [
    "file_name", "GameUID", "PitchUID", "Level", "Inning", "Top/Bottom", "PAofInning", "PitchofPA", "PitchNo", "Outs", "Balls", "Strikes", "PitchCall", "PlayResult",
    "KorBB", "OutsOnPlay", "RunsScored", "ThrowSpeed",
]


def postseason_start(year: Column) -> Column:
    """The Friday after the last Monday of May."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(5), F.lit(31)), 7), "Mon"), 4)


def file_date(name: Column) -> Column:
    return F.when(F.substring(name, 1, 8).rlike("^[0-9]{8}$"), F.try_to_timestamp(F.substring(name, 1, 8), F.lit("yyyyMMdd"))).cast("date")


def play_order() -> list[Column]:
    keys = ["Inning", F.when(F.col("Top/Bottom") == "Top", 0).otherwise(1), "PAofInning", "PitchofPA", "PitchNo", "PitchUID"]
    return [F.asc_nulls_last(k) for k in keys]


def game_flags(pitches: DataFrame) -> DataFrame:
    """Per file: whether steals are labelled, whether throws are tracked, its level, whether extra innings start with
    a runner, and whether steals are guessed from throws."""
    first = F.min(F.when(F.col("Level").isNotNull(), F.struct(
        *[x for k in ("Inning", "PAofInning", "PitchofPA", "PitchNo") for x in (F.col(k).isNull().alias(f"no_{k}"), F.col(k))],
        F.col("PitchUID"), F.col("Level"),
    )))
    seen = pitches.groupBy("file_name").agg(
        F.coalesce(F.bool_or(F.col("PlayResult").isin(STEALS)), F.lit(False)).alias("has_labels"),
        F.bool_or(F.col("ThrowSpeed").isNotNull()).alias("has_throws"),
        first["Level"].alias("level"),
    )
    date = file_date(F.col("file_name"))
    late = (F.col("level") == "D1") & (date >= postseason_start(F.year(date)))
    return seen.withColumns({"ghost": ~F.coalesce(late, F.lit(False)), "guess": ~F.col("has_labels") & F.col("has_throws")})


def annotate(pitches: DataFrame) -> DataFrame:
    """``pitches`` with ``on_1b, on_2b, on_3b, base_state, re288_state`` as they stood before each pitch.

    A game is its file and GameUID. Values outside the signature's domains are read as no event of that kind; counts
    are clipped to the domain's end.
    """
    own = [c for c in pitches.columns if c not in ("on_1b", "on_2b", "on_3b", "base_state", "re288_state")]
    flags = game_flags(pitches).select("file_name", "ghost", "guess")
    known = lambda c: F.when(F.col(c).isin(DOMAINS[c]), F.col(c)).otherwise("Other")
    table = F.broadcast(signatures(pitches.sparkSession))
    keyed = pitches.select(*own).join(flags, "file_name").withColumns(
        {
            "s_result": known("PlayResult"),
            "s_walk": known("KorBB"),
            "s_hbp": F.coalesce(F.col("PitchCall") == "HitByPitch", F.lit(False)),
            "s_outs": F.least(F.greatest(F.coalesce("OutsOnPlay", F.lit(0)), F.lit(0)), F.lit(MAX_OUTS)).cast("int"),
            "s_runs": F.least(F.greatest(F.coalesce("RunsScored", F.lit(0)), F.lit(0)), F.lit(MAX_RUNS)).cast("int"),
            "s_guess": F.col("guess") & F.col("ThrowSpeed").isNotNull(),
        }
    )
    moved = keyed.join(table, ["s_result", "s_walk", "s_hbp", "s_outs", "s_runs", "s_guess"], "left")
    none = F.array(*[F.lit(i) for i in range(8)])
    half = ["file_name", "GameUID", "Inning", "Top/Bottom"]
    order = Window.partitionBy(*half).orderBy(*play_order())
    row = F.struct(*[F.col(c) for c in own])
    item = F.struct(F.row_number().over(order).alias("at"), F.coalesce("moves", none).alias("moves"), row.alias("row"), F.col("ghost"))
    halves = moved.select(*half, item.alias("x")).groupBy(*half).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.when(F.get(F.col("xs"), F.lit(0))["ghost"] & (F.col("Inning") >= EXTRA_INNING), 2).otherwise(0)
    state = F.struct(start.alias("now"), F.array().cast("array<int>").alias("before"))
    states = F.aggregate(
        "xs", state,
        lambda a, x: F.struct(F.get(x["moves"], a["now"]).alias("now"), F.concat(a["before"], F.array(a["now"])).alias("before")),
    )["before"]
    both = F.zip_with("xs", states, lambda x, s: F.struct(x["row"].alias("row"), s.alias("state")))
    out = halves.select(F.explode(both).alias("b")).select("b.row.*", F.col("b.state").alias("state"))
    on = {f"on_{i + 1}b": F.getbit("state", F.lit(i)).cast("byte") for i in range(3)}
    text = F.concat(*[F.getbit("state", F.lit(i)).cast("string") for i in range(3)])
    return out.withColumns(on).withColumn("base_state", text).withColumn("re288_state", state_text()).drop("state")
