"""Test tables in the shape of pitches.

The same text runs in both engines but for integer division and date format; every picked value is integer arithmetic
on keys, so both agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.shared import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

_TEXT = """
base AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, c.c_name, s.s_name, s.s_nationkey, n.n_regionkey,
    l.l_orderkey {div} 6 AS half
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
), placed AS (
  SELECT *, half {div} 24 AS game, CAST(row_number() OVER (PARTITION BY half
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS pn,
    min(o_orderdate) OVER (PARTITION BY half {div} 24) AS played
  FROM base
), picked AS (
  SELECT *, (3 * l_partkey + 5 * l_suppkey + 7 * pn) % 12 AS e FROM placed
), pitches AS (
  SELECT
    concat({ymd_played}, '-', CAST(game AS STRING), '.csv') AS file_name,
    pn AS PitchNo, {iso} AS Date, 1 + (pn - 1) {div} 4 AS PAofInning, 1 + (pn - 1) % 4 AS PitchofPA,
    s_name AS Pitcher, CAST(l_suppkey AS STRING) AS PitcherId,
    CASE WHEN l_suppkey % 10 = 0 THEN 'Undefined' WHEN l_suppkey % 2 = 0 THEN 'Left' ELSE 'Right' END AS PitcherThrows,
    concat('T', CAST(s_nationkey AS STRING)) AS PitcherTeam,
    c_name AS Batter, CASE WHEN o_custkey % 23 <> 0 THEN CAST(o_custkey AS STRING) END AS BatterId,
    CASE WHEN o_custkey % 10 = 0 THEN 'Undefined' WHEN (o_custkey + l_suppkey) % 3 = 0 THEN 'Left' ELSE 'Right' END AS BatterSide,
    concat('T', CAST((s_nationkey + 7) % 25 AS STRING)) AS BatterTeam,
    1 + half % 12 AS Inning, CASE WHEN (half {div} 12) % 2 = 0 THEN 'Top' ELSE 'Bottom' END AS half_name,
    l_suppkey % 3 AS Outs, l_partkey % 4 AS Balls, (l_partkey {div} 4) % 3 AS Strikes,
    CASE l_partkey % 9 WHEN 0 THEN 'Fastball' WHEN 1 THEN 'FourSeamFastBall' WHEN 2 THEN 'Sinker' WHEN 3 THEN 'Slider'
      WHEN 4 THEN 'Curveball' WHEN 5 THEN 'ChangeUp' WHEN 6 THEN 'Other' WHEN 7 THEN 'OneSeamFastBall' ELSE 'Undefined' END AS TaggedPitchType,
    CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'Four-Seam' WHEN l_partkey % 5 = 1 THEN 'Changeup'
      WHEN l_partkey % 5 = 2 THEN 'Slider' WHEN l_partkey % 5 = 3 THEN 'Sinker' ELSE 'Other' END AS AutoPitchType,
    CASE WHEN l_partkey % 17 = 0 AND e NOT BETWEEN 0 AND 8 THEN NULL WHEN e = 0 THEN 'StrikeSwinging' WHEN e BETWEEN 1 AND 6 THEN 'InPlay'
      WHEN e = 7 THEN 'BallCalled' WHEN e = 8 AND l_partkey % 3 = 0 THEN 'HitByPitch'
      ELSE CASE l_partkey % 7 WHEN 0 THEN 'BallCalled' WHEN 1 THEN 'StrikeCalled' WHEN 2 THEN 'StrikeSwinging'
        WHEN 3 THEN 'FoulBallNotFieldable' WHEN 4 THEN 'FoulBallFieldable' WHEN 5 THEN 'BallinDirt' ELSE 'FoulBall' END END AS PitchCall,
    CASE e WHEN 0 THEN 'Strikeout' WHEN 7 THEN 'Walk' ELSE 'Undefined' END AS KorBB,
    CASE WHEN e NOT BETWEEN 1 AND 6 THEN 'Undefined' ELSE CASE l_partkey % 5 WHEN 0 THEN 'GroundBall' WHEN 1 THEN 'FlyBall'
      WHEN 2 THEN 'LineDrive' WHEN 3 THEN 'Popup' ELSE 'Bunt' END END AS TaggedHitType,
    CASE WHEN e BETWEEN 1 AND 3 THEN 'Out' WHEN e = 4 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Out' ELSE 'FieldersChoice' END
      WHEN e = 5 THEN CASE (l_partkey + pn) % 5 WHEN 0 THEN 'Single' WHEN 1 THEN 'Double' WHEN 2 THEN 'Triple' WHEN 3 THEN 'HomeRun' ELSE 'Error' END
      WHEN e = 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Sacrifice' ELSE 'Single' END
      WHEN e = 8 AND l_partkey % 3 = 1 AND game % 2 = 0 THEN 'StolenBase'
      WHEN e = 8 AND l_partkey % 3 = 2 AND game % 2 = 0 THEN 'CaughtStealing' ELSE 'Undefined' END AS PlayResult,
    CAST(CASE WHEN e BETWEEN 1 AND 3 THEN 1 WHEN e = 4 THEN 2 WHEN e = 10 AND l_partkey % 8 = 0 THEN 1 ELSE 0 END AS BIGINT) AS OutsOnPlay,
    CAST(CASE WHEN e = 5 THEN l_suppkey % 3 WHEN e = 6 THEN l_partkey % 2 WHEN e = 9 AND l_partkey % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS RunsScored,
    CAST(800 + l_partkey % 160 AS DOUBLE) / 10 AS RelSpeed, CAST(1800 + l_suppkey % 700 + l_partkey % 100 AS DOUBLE) AS SpinRate,
    CAST((l_partkey * 7 + l_suppkey) % 360 AS DOUBLE) AS SpinAxis, CAST(50 + l_suppkey % 20 AS DOUBLE) / 10 AS RelHeight,
    CAST(l_suppkey % 40 - 20 AS DOUBLE) / 10 AS RelSide, CASE WHEN l_partkey % 29 <> 0 THEN CAST(55 + l_suppkey % 15 AS DOUBLE) / 10 END AS Extension,
    CAST(l_partkey % 45 - 20 AS DOUBLE) / 2 AS InducedVertBreak, CAST(l_partkey % 37 - 18 AS DOUBLE) / 2 AS HorzBreak,
    CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_partkey % 61 AS DOUBLE) / 13 + CAST(l_suppkey % 7 AS DOUBLE) / 100 END AS PlateLocHeight,
    CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_partkey % 53 - 26 AS DOUBLE) / 13 + CAST(l_suppkey % 11 AS DOUBLE) / 100 END AS PlateLocSide,
    CASE WHEN l_partkey % 11 <> 0 THEN CAST(600 + l_partkey % 500 AS DOUBLE) / 10 END AS ExitSpeed,
    CASE WHEN l_partkey % 31 <> 0 THEN CAST(l_partkey % 151 - 60 AS DOUBLE) END AS Angle, CAST(l_partkey % 91 - 45 AS DOUBLE) AS Direction,
    CAST(l_partkey % 91 - 45 + l_suppkey % 9 - 4 AS DOUBLE) AS Bearing, CAST(50 + l_partkey % 350 AS DOUBLE) AS Distance,
    CASE WHEN e = 10 AND l_partkey % 4 = 0 AND game % 2 = 1 THEN CAST(70 + l_suppkey % 15 AS DOUBLE) END AS ThrowSpeed,
    CASE WHEN n_regionkey < 3 THEN 'D1' ELSE 'JUCO' END AS Level,
    CASE s_nationkey % 6 WHEN 0 THEN 'SEC' WHEN 1 THEN 'ACC' WHEN 2 THEN 'BIG10' WHEN 3 THEN 'BIG12' WHEN 4 THEN 'IVY' ELSE 'WAC' END AS League,
    CAST(game AS STRING) AS GameID, concat('G', CAST(game AS STRING)) AS GameUID,
    concat(CAST(half AS STRING), '-', CAST(pn AS STRING)) AS PitchUID,
    CASE WHEN n_regionkey < 3 THEN 'D1' ELSE 'Others' END AS part, substr({ymd_played}, 1, 4) AS file_year,
    concat(CAST((l_partkey {div} 12) % 2 AS STRING), CAST((l_partkey {div} 24) % 2 AS STRING), CAST((l_suppkey {div} 3) % 2 AS STRING)) AS base_state,
    CASE WHEN e BETWEEN 1 AND 6 AND l_partkey % 11 <> 0 THEN CAST(l_partkey % 200 - 60 AS DOUBLE) / 100 END AS xRV
  FROM picked
)"""


def pitches_cte(dialect: str = "duckdb") -> str:
    """Common table expressions that end with ``pitches``; ``half_name`` stands for Top/Bottom."""
    if dialect == "spark":
        words = {"div": "div", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "ymd_played": "date_format(played, 'yyyyMMdd')"}
    else:
        words = {"div": "//", "iso": "strftime(o_orderdate, '%Y-%m-%d')", "ymd_played": "strftime(played, '%Y%m%d')"}
    return _TEXT.format(**words)


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch table made from ``lineitem``, with its own temporary views."""
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier", "nation")}
    text = f"WITH {pitches_cte('spark')} SELECT * FROM pitches"
    for name in own:
        text = text.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(text, **own).withColumnRenamed("half_name", "Top/Bottom")


_TREES: dict[tuple[str, str], DataFrame] = {}


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the engine keeps pitches: files in folders by part and year. Made once a session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TREES:
        _TREES[key] = written(made(spark, sf_dir), "pitches", "part", "file_year")
    return _TREES[key]
