"""DuckDB SQL for the driver queries, written on its own from the rules, not from the Spark code."""

from __future__ import annotations

from ..adapter import pitches_cte

ORACLES: dict[str, str] = {}
LEVEL, YEAR = "D1", "1995"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + 1e-9, {digits}) + 0.0 AS {name}"


def n(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def over_pitches(name: str, body: str, more: str = "") -> None:
    ORACLES[name] = f"WITH {pitches_cte()}{more} {body}"


#: Calls and leagues, as the data names them.
STRIKE = "('StrikeCalled','StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay')"
SWING = "('StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay')"
POOLED = "('SEC','ACC','BIG10','BIG12')"
TEXT = "base_state || '|' || Outs || '|' || Balls || '-' || Strikes"
PLAY = "PAofInning NULLS LAST, PitchofPA NULLS LAST, PitchNo NULLS LAST, PitchUID NULLS LAST"

# Runs ---------------------------------------------------------------------------------------------

LEFT = """, ending AS (
  SELECT *, sum(coalesce(OutsOnPlay, 0) + CASE WHEN KorBB = 'Strikeout' THEN 1 ELSE 0 END) OVER (PARTITION BY GameUID, Inning, half_name) AS half_outs,
    sum(RunsScored) OVER (PARTITION BY GameUID, Inning, half_name ORDER BY {play} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS runs_left
  FROM pitches {where}
), whole AS (SELECT * FROM ending WHERE half_outs >= 3 AND (Inning < 10 OR Level = 'D1')),
levelled AS (SELECT Level AS lv, * FROM whole UNION ALL SELECT 'P4', * FROM whole WHERE League IN {pooled}),
matrix AS (SELECT lv AS Level, file_year AS year, base_state, Outs, Balls, Strikes, count(*) AS n_obs, avg(runs_left) AS re FROM levelled GROUP BY ALL)"""
MATRIX = LEFT.format(play=PLAY, where="", pooled=POOLED)
SHOWN = f"SELECT Level, year, base_state, {n('Outs', 'Outs')}, {n('Balls', 'Balls')}, {n('Strikes', 'Strikes')}, {n('n_obs', 'n_obs')}, {r('re', 'run_expectancy')}, {TEXT} AS re288_state FROM matrix"
over_pitches("re_matrix", SHOWN, MATRIX)
over_pitches("re_matrix_pooled_level", SHOWN + " WHERE Level = 'P4'", MATRIX)
over_pitches("re_matrix_extra_innings", SHOWN, LEFT.format(play=PLAY, where="WHERE Inning >= 10", pooled=POOLED))

CELLS = f", cells AS (SELECT * FROM matrix WHERE Level = '{LEVEL}' AND year = '{YEAR}')"


def delta(game: str, source: str) -> str:
    return f""", joined AS (
  SELECT p.*, c.re AS re_now FROM {source} p LEFT JOIN cells c ON (p.base_state, p.Outs, p.Balls, p.Strikes) = (c.base_state, c.Outs, c.Balls, c.Strikes)
  WHERE p.Level = '{LEVEL}' AND p.file_year = '{YEAR}'
), valued AS (
  SELECT *, RunsScored + coalesce(lead(re_now) OVER (PARTITION BY {game}, Inning, half_name ORDER BY {PLAY}), 0) - re_now AS run_delta FROM joined)"""


over_pitches("run_delta", f"SELECT PitchUID, {TEXT} AS re288_state, {r('re_now', 're_now')}, {r('run_delta', 'run_delta')} FROM valued", MATRIX + CELLS + delta("GameID", "pitches"))
BATTED = "ExitSpeed IS NOT NULL AND Angle IS NOT NULL AND Direction IS NOT NULL AND PlayResult IN ('Out','Single','Double','Triple','HomeRun')"
over_pitches(
    "linear_weights",
    f"""SELECT {n("o.i - 1", "place")}, o.name AS PlayResult, {r("avg(v.run_delta)", "weight")}, {n("count(v.PitchUID)", "n")}
    FROM (SELECT unnest(['Out','Single','Double','Triple','HomeRun']) AS name, unnest([1,2,3,4,5]) AS i) o
    LEFT JOIN (SELECT * FROM valued WHERE {BATTED}) v ON v.PlayResult = o.name GROUP BY o.i, o.name""",
    MATRIX + CELLS + delta("GameID", "pitches"),
)
over_pitches(
    "run_value_by_count",
    f"SELECT {n('Balls', 'Balls')}, {n('Strikes', 'Strikes')}, {n('count(run_delta)', 'n')}, {r('avg(run_delta)', 'run_value')} FROM valued GROUP BY Balls, Strikes",
    MATRIX + CELLS + delta("GameUID", "whole"),
)
over_pitches(
    "count_run_values",
    f"""SELECT {n("Balls", "Balls")}, {n("Strikes", "Strikes")}, {r("sum(s * n_obs) / sum(n_obs) FILTER (s IS NOT NULL)", "rv_strike")},
      {r("sum(b * n_obs) / sum(n_obs) FILTER (b IS NOT NULL)", "rv_ball")}
    FROM (SELECT c.*,
      CASE WHEN c.Strikes < 2 THEN (SELECT max(x.re) FROM cells x WHERE x.base_state = c.base_state AND x.Outs = c.Outs AND x.Balls = c.Balls AND x.Strikes = c.Strikes + 1)
        WHEN c.Outs = 2 THEN 0 ELSE (SELECT max(x.re) FROM cells x WHERE x.base_state = c.base_state AND x.Outs = c.Outs + 1 AND x.Balls = 0 AND x.Strikes = 0) END - c.re AS s,
      CASE WHEN c.Balls < 3 THEN (SELECT max(x.re) FROM cells x WHERE x.base_state = c.base_state AND x.Outs = c.Outs AND x.Balls = c.Balls + 1 AND x.Strikes = c.Strikes)
        ELSE (SELECT max(x.re) FROM cells x WHERE x.base_state = (CASE c.base_state WHEN '000' THEN '100' WHEN '100' THEN '110' WHEN '010' THEN '110' WHEN '001' THEN '101' ELSE '111' END)
          AND x.Outs = c.Outs AND x.Balls = 0 AND x.Strikes = 0) + CASE WHEN c.base_state = '111' THEN 1 ELSE 0 END END - c.re AS b
      FROM cells c) GROUP BY Balls, Strikes""",
    MATRIX + CELLS,
)
over_pitches(
    "shrinkage_leaderboard",
    f"""SELECT Pitcher, {n("n", "n")}, {r("m", "mean")}, {r("100 * (mu + n / (n + s2 / tau) * (m - mu))", "per_100")}
    FROM g, t, (SELECT greatest((sum(n * (m - mu) ** 2) - (count(*) - 1) * any_value(s2)) / (sum(n) - sum(n * n) / sum(n)), 1e-12) AS tau FROM g, t) WHERE n >= 300""",
    """, rows_ AS (SELECT Pitcher, ExitSpeed AS v FROM pitches WHERE ExitSpeed IS NOT NULL), g AS (SELECT Pitcher, count(*)::DOUBLE AS n, avg(v) AS m FROM rows_ GROUP BY Pitcher),
    t AS (SELECT avg(v) AS mu, var_samp(v) AS s2 FROM rows_)""",
)
over_pitches(
    "season_correlation",
    f"SELECT {n('count(*)', 'n')}, {r('corr(x, y)', 'pearson')}, {r('corr(rx, ry)', 'spearman')} FROM (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM b)",
    """, b AS (SELECT Pitcher, avg(RelSpeed) FILTER (half_name = 'Top') AS x, avg(RelSpeed) FILTER (half_name = 'Bottom') AS y FROM pitches GROUP BY Pitcher HAVING x IS NOT NULL AND y IS NOT NULL)""",
)

# State: independent CASE logic over states 0-7 (first base 1, second 2, third 4) ----------------------


def home(state: str, k: str) -> str:
    """The foremost k runners score: keep the lowest (count - k) bits."""
    low = f"(CASE WHEN ({state}) % 2 = 1 THEN 1 WHEN ({state}) % 4 >= 2 THEN 2 ELSE ({state}) END)"
    top1 = f"(CASE WHEN ({state}) >= 4 THEN ({state}) - 4 WHEN ({state}) >= 2 THEN ({state}) - 2 ELSE 0 END)"
    return f"(CASE WHEN ({k}) <= 0 THEN ({state}) WHEN ({k}) = 1 THEN {top1} WHEN ({k}) = 2 AND ({state}) = 7 THEN {low} ELSE 0 END)"


def trail(state: str, k: str) -> str:
    """The rearmost k runners are out."""
    once = lambda s: f"(CASE {s} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE 6 END)"
    twice = f"(CASE {state} WHEN 7 THEN 4 ELSE 0 END)"
    return f"(CASE WHEN ({k}) <= 0 THEN {state} WHEN ({k}) = 1 THEN {once(state)} WHEN ({k}) = 2 THEN {twice} ELSE 0 END)"


STOLEN = "(CASE WHEN rs > 0 AND st >= 4 THEN st - 4 ELSE CASE st WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 5 THEN 6 ELSE st END END)"
RAN = f"""CASE WHEN pr = 'StolenBase' THEN {STOLEN} WHEN pr = 'CaughtStealing' THEN {trail("st", "1")}
  WHEN pr = 'Undefined' AND kb = 'Undefined' AND NOT hbp AND guess AND threw AND st > 0 THEN CASE WHEN oop > 0 THEN {trail("st", "1")} ELSE {STOLEN} END
  WHEN pr = 'Undefined' AND kb = 'Undefined' AND NOT hbp AND rs > 0 THEN {home("st", "rs")} ELSE st END"""


def _hit(bases: int) -> str:
    kept = {1: "(CASE WHEN s >= 4 THEN s - 4 ELSE s END) * 2 + 1", 2: "(s % 2) * 4 + 2", 3: "4", 4: "0"}[bases]
    scored = {
        1: "(CASE WHEN s >= 4 THEN 1 ELSE 0 END)",
        2: "(CASE WHEN s >= 4 THEN 1 ELSE 0 END + CASE WHEN s % 4 >= 2 THEN 1 ELSE 0 END)",
        3: "bit_count(s)",
        4: "(bit_count(s) + 1)",
    }[bases]
    return home(kept, f"rs - {scored}")


BATTED_ON = f"""CASE WHEN kb = 'Walk' OR hbp THEN CASE s WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 5 ELSE 7 END WHEN kb = 'Strikeout' THEN s
  WHEN pr IN ('Single', 'Error') THEN {_hit(1)} WHEN pr = 'Double' THEN {_hit(2)} WHEN pr = 'Triple' THEN {_hit(3)} WHEN pr = 'HomeRun' THEN 0
  WHEN pr = 'Sacrifice' THEN {home("(CASE WHEN s >= 4 THEN s - 4 ELSE s END) * 2", "rs - (CASE WHEN s >= 4 THEN 1 ELSE 0 END)")}
  WHEN pr = 'FieldersChoice' THEN {home("(CASE WHEN f % 2 = 1 THEN f ELSE f + 1 END)", "rs")}
  WHEN pr = 'Out' THEN {home("o", "rs")} ELSE s END"""
FLAGS = """, flags AS (
  SELECT file_name, count(*) FILTER (PlayResult IN ('StolenBase', 'CaughtStealing')) > 0 AS has_labels, count(ThrowSpeed) > 0 AS has_throws,
    arg_min(Level, (Inning, PAofInning, PitchofPA, PitchNo, PitchUID)) AS level, try_strptime(substr(file_name, 1, 8), '%Y%m%d')::DATE AS day
  FROM pitches GROUP BY file_name
), flagged AS (
  SELECT *, NOT coalesce(level = 'D1' AND day >= (SELECT max(x)::DATE FROM generate_series(make_date(year(day), 5, 25), make_date(year(day), 5, 31), INTERVAL 1 DAY) g(x) WHERE isodow(x) = 1) + 4, false) AS ghost,
    NOT has_labels AND has_throws AS guess FROM flags)"""
over_pitches("game_flags", "SELECT file_name, has_labels, has_throws, level, ghost, guess FROM flagged", FLAGS)
over_pitches(
    "base_state_fold",
    f"""SELECT PitchUID, {n("st % 2", "on_1b")}, {n("(st // 2) % 2", "on_2b")}, {n("st // 4", "on_3b")}, (st % 2) || '' || ((st // 2) % 2) || '' || (st // 4) AS base_state,
      (st % 2) || '' || ((st // 2) % 2) || '' || (st // 4) || '|' || Outs || '|' || Balls || '-' || Strikes AS re288_state FROM walk""",
    FLAGS
    + f""", lined AS (
  SELECT p.PitchUID, p.Outs, p.Balls, p.Strikes, dense_rank() OVER (ORDER BY p.file_name, p.GameUID, p.Inning, p.half_name) AS h,
    row_number() OVER (PARTITION BY p.file_name, p.GameUID, p.Inning, p.half_name ORDER BY {PLAY}) AS i, p.PlayResult AS pr, p.KorBB AS kb,
    coalesce(p.PitchCall = 'HitByPitch', false) AS hbp, p.OutsOnPlay::INT AS oop, p.RunsScored::INT AS rs, p.ThrowSpeed IS NOT NULL AS threw, g.guess, g.ghost AND p.Inning >= 10 AS start
  FROM pitches p JOIN flagged g USING (file_name)
), walk AS (
  SELECT *, CASE WHEN start THEN 2 ELSE 0 END AS st FROM lined WHERE i = 1
  UNION ALL
  SELECT l.*, x.nx FROM (
    SELECT h, i, {BATTED_ON} AS nx FROM (SELECT *, {trail("s", "oop - 1")} AS o, {trail("s", "greatest(1, oop)")} AS f FROM (SELECT *, {RAN} AS s FROM walk))
  ) x JOIN lined l ON l.h = x.h AND l.i = x.i + 1
)""",
)
ORACLES["base_state_fold"] = ORACLES["base_state_fold"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["postseason_start"] = (
    "SELECT CAST(y AS BIGINT) AS year, strftime((SELECT max(x)::DATE + 4 FROM generate_series(make_date(y, 5, 25), make_date(y, 5, 31), INTERVAL 1 DAY) g(x) WHERE isodow(x) = 1), '%Y-%m-%d') AS start"
    " FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)"
)

# Reports ------------------------------------------------------------------------------------------

over_pitches(
    "pitcher_summary",
    f"""SELECT Pitcher, {n("p", "pitches")}, {n("bf", "batters_faced")}, {n("k", "strikeouts")}, {n("bb + hbp", "free_passes")}, {n("h", "hits")}, {n("oop + k", "outs")},
      {n("(oop + k) // 3", "innings")}, {n("(oop + k) % 3", "innings_rest")}, {n("k + ret", "retired")}, {r("rh", "rel_height")}, {r("rs", "rel_side")}, {r("ext", "extension")}, {r("x", "xrv")},
      {r("p / nullif(bf, 0)", "pitches_per_pa")}, {r("k / nullif(bf, 0)", "k_rate")}, {r("bb / nullif(bf, 0)", "bb_rate")} FROM (
      SELECT Pitcher, count(*) AS p, sum((PitchofPA = 1)::INT) AS bf, sum((KorBB = 'Strikeout')::INT) AS k, sum((KorBB = 'Walk')::INT) AS bb, count(*) FILTER (PitchCall = 'HitByPitch') AS hbp,
        sum((PlayResult IN ('Single','Double','Triple','HomeRun'))::INT) AS h, sum(OutsOnPlay) AS oop, sum((PlayResult IN ('Out','Sacrifice'))::INT) AS ret,
        avg(RelHeight) AS rh, avg(RelSide) AS rs, avg(Extension) AS ext, avg(xRV) AS x FROM pitches GROUP BY Pitcher)""",
)


def _arsenal(where: str, columns: list[str]) -> str:
    known = {
        "n": n("n", "n"), "velo": r("velo", "velo"), "velo_max": r("vmax", "velo_max"), "spin": r("spin", "spin"), "strike_rate": r("strike", "strike_rate"), "whiffs": n("whiffs", "whiffs"),
        "swings": n("swings", "swings"), "vert_break": r("vb", "vert_break"), "horz_break": r("hb", "horz_break"), "rel_height": r("rh", "rel_height"), "rel_side": r("rs", "rel_side"),
        "extension": r("ext", "extension"), "exit_speed": r("ev", "exit_speed"), "hard_hit": r("hh", "hard_hit"), "xrv": r("x", "xrv"), "usage": r("n / al", "usage"),
        "whiff_rate": r("whiffs / nullif(swings, 0)", "whiff_rate"),
    }
    return f"""SELECT Pitcher, TaggedPitchType, {", ".join(known[c] for c in columns or known)} FROM (
      SELECT *, sum(n) OVER (PARTITION BY Pitcher) AS al FROM (
      SELECT Pitcher, TaggedPitchType, count(*) AS n, avg(RelSpeed) AS velo, max(RelSpeed) AS vmax, avg(SpinRate) AS spin, avg((PitchCall IN {STRIKE})::INT) AS strike,
        count(*) FILTER (PitchCall = 'StrikeSwinging') AS whiffs, count(*) FILTER (PitchCall IN {SWING}) AS swings, avg(InducedVertBreak) AS vb, avg(HorzBreak) AS hb, avg(RelHeight) AS rh,
        avg(RelSide) AS rs, avg(Extension) AS ext, avg(ExitSpeed) AS ev, avg((ExitSpeed >= 95)::INT) AS hh, avg(xRV) AS x FROM pitches WHERE {where} GROUP BY ALL))
      WHERE TaggedPitchType NOT IN ('Undefined', 'Other')"""


over_pitches("arsenal", _arsenal("true", []))
over_pitches("arsenal_split_hand_count", _arsenal("BatterSide = 'Left' AND (Strikes = 2 OR (Balls = 1 AND Strikes = 0))", ["n", "usage", "velo"]))
over_pitches("spin_circular_mean", f"SELECT TaggedPitchType, {r('(degrees(atan2(avg(sin(radians(SpinAxis))), avg(cos(radians(SpinAxis))))) + 360) % 360', 'spin_axis')} FROM pitches GROUP BY 1")
over_pitches(
    "spin_clock",
    f"""SELECT {r("a", "SpinAxis")}, (CASE WHEN q // 4 = 0 THEN 12 ELSE q // 4 END) || ':' || lpad((q % 4 * 15)::VARCHAR, 2, '0') AS clock
    FROM (SELECT a, (CAST(round_even(((a + 180) % 360) / 30 * 4, 0) AS INT)) % 48 AS q FROM (SELECT DISTINCT SpinAxis AS a FROM pitches))""",
)
over_pitches("throws_mode", "SELECT Pitcher, arg_max(PitcherThrows, (c, -ascii(PitcherThrows))) AS hand FROM (SELECT Pitcher, PitcherThrows, count(*) AS c FROM pitches GROUP BY ALL) GROUP BY Pitcher")
over_pitches(
    "movement",
    f"""SELECT Pitcher, TaggedPitchType, PitchUID, {r("HorzBreak", "HorzBreak")}, {r("InducedVertBreak", "InducedVertBreak")}, {n("c", "n")}, {n("place", "place")}
    FROM pitches JOIN (SELECT *, row_number() OVER (PARTITION BY Pitcher ORDER BY c DESC, TaggedPitchType) AS place FROM (
      SELECT Pitcher, TaggedPitchType, count(*) AS c FROM pitches WHERE TaggedPitchType NOT IN ('Undefined', 'Other') GROUP BY ALL)) USING (Pitcher, TaggedPitchType)""",
)
over_pitches(
    "batter_summary",
    f"""SELECT Batter, {n("pa", "pa")}, {n("b2", "b2")}, {n("b3", "b3")}, {n("hr", "hr")}, {n("bb", "bb")}, {n("so", "so")}, {n("hbp", "hbp")}, {r("ev", "exit_speed")}, {r("hh", "hard_hit")}, {r("la", "launch_angle")},
      {r("x", "xrv")}, {n("h", "h")}, {n("ab", "ab")}, {r("h / nullif(ab, 0)", "avg")}, {r("(h + bb + hbp) / nullif(ab + bb + hbp + sac, 0)", "obp")}, {r("tb / nullif(ab, 0)", "slg")},
      {r("so / nullif(pa, 0)", "k_rate")}, {r("bb / nullif(pa, 0)", "bb_rate")}, {r("(h + bb + hbp) / nullif(ab + bb + hbp + sac, 0) + tb / nullif(ab, 0)", "ops")}
    FROM (SELECT *, b1 + b2 + b3 + hr AS h, pa - bb - hbp - sac AS ab, b1 + 2 * b2 + 3 * b3 + 4 * hr AS tb FROM (
      SELECT Batter, count(*) FILTER (PitchofPA = 1) AS pa, count(*) FILTER (PlayResult = 'Single') AS b1, count(*) FILTER (PlayResult = 'Double') AS b2, count(*) FILTER (PlayResult = 'Triple') AS b3,
        count(*) FILTER (PlayResult = 'HomeRun') AS hr, count(*) FILTER (PlayResult = 'Sacrifice') AS sac, count(*) FILTER (KorBB = 'Walk') AS bb, count(*) FILTER (KorBB = 'Strikeout') AS so,
        count(*) FILTER (PitchCall = 'HitByPitch') AS hbp, avg(ExitSpeed) FILTER (PitchCall = 'InPlay') AS ev, avg((ExitSpeed >= 95)::INT) FILTER (PitchCall = 'InPlay') AS hh,
        avg(Angle) FILTER (PitchCall = 'InPlay') AS la, avg(xRV) AS x FROM pitches GROUP BY Batter))""",
)
over_pitches(
    "bats_side",
    f"""SELECT Batter, {n("l", '"left"')}, {n("rr", '"right"')}, CASE WHEN k = 0 THEN '' WHEN l + rr > 0 AND least(l, rr) / (l + rr) >= 0.2::DOUBLE THEN 'S' WHEN l >= rr THEN 'L' ELSE 'R' END AS bats
    FROM (SELECT Batter, count(BatterSide) AS k, count(*) FILTER (BatterSide = 'Left') AS l, count(*) FILTER (BatterSide = 'Right') AS rr FROM pitches GROUP BY Batter)""",
)
FAMILY = "CASE WHEN {0} IN ('Fastball','FourSeamFastBall','Sinker','TwoSeamFastBall','OneSeamFastBall') THEN 'Fastballs' WHEN {0} IN ('Curveball','Slider','Cutter','Slurve','Sweeper') THEN 'Breaking' WHEN {0} IN ('ChangeUp','Splitter') THEN 'Offspeed' ELSE 'Others' END"
TYPED = f""", typed AS (SELECT *, CASE WHEN {FAMILY.format("TaggedPitchType")} <> 'Others' THEN TaggedPitchType WHEN AutoPitchType = 'Four-Seam' THEN 'FourSeamFastBall' WHEN AutoPitchType = 'Changeup' THEN 'ChangeUp' ELSE AutoPitchType END AS eff FROM pitches),
named AS (SELECT *, {FAMILY.format("eff")} AS family, CASE eff WHEN 'FourSeamFastBall' THEN 'Four-Seam' WHEN 'TwoSeamFastBall' THEN 'Two-Seam' WHEN 'OneSeamFastBall' THEN 'Fastball' WHEN 'ChangeUp' THEN 'Changeup' ELSE eff END AS sub,
  PlateLocSide IS NOT NULL AND PlateLocHeight IS NOT NULL AS loc, coalesce(abs(PlateLocSide) <= 0.83 AND PlateLocHeight BETWEEN 1.5 AND 3.3775, false) AS iz, PitchCall IN {SWING} AS sw FROM typed)"""
SUMS = """count(*) AS n, count(*) FILTER (sw) AS swings, count(*) FILTER (PitchCall = 'StrikeSwinging') AS whiffs, count(*) FILTER (loc) AS located, count(*) FILTER ((iz AND sw) OR (loc AND NOT iz AND NOT sw)) AS good,
  count(*) FILTER (iz) AS zone, count(*) FILTER (iz AND sw) AS zone_swings, count(*) FILTER (iz AND PitchCall = 'StrikeSwinging') AS zone_whiffs, count(*) FILTER (loc AND NOT iz) AS "out", count(*) FILTER (loc AND NOT iz AND sw) AS out_swings,
  count(ExitSpeed) FILTER (PitchCall = 'InPlay') AS tracked, count(*) FILTER (PitchCall = 'InPlay' AND ExitSpeed >= 95) AS hard, coalesce(sum(ExitSpeed) FILTER (PitchCall = 'InPlay'), 0) AS speed_sum, count(xRV) AS xrv_n, coalesce(sum(xRV), 0) AS xrv_sum"""
COUNTS = ["n", "swings", "whiffs", "located", "good", "zone", "zone_swings", "zone_whiffs", '"out"', "out_swings", "tracked", "hard", "xrv_n"]
over_pitches("pitch_family_components", f"SELECT Batter, family, sub, {', '.join(n(c, c) for c in COUNTS)}, {r('speed_sum', 'speed_sum')}, {r('xrv_sum', 'xrv_sum')} FROM (SELECT Batter, family, sub, {SUMS} FROM named GROUP BY ALL)", TYPED)
RATES = {
    "swing_rate": "swings / nullif(n, 0)", "contact_rate": "(swings - whiffs) / nullif(swings, 0)", "good_rate": "good / nullif(located, 0)", "whiff_rate": "whiffs / nullif(swings, 0)",
    "zone_swing_rate": "zone_swings / nullif(zone, 0)", "zone_whiff_rate": "zone_whiffs / nullif(zone_swings, 0)", "chase_rate": 'out_swings / nullif("out", 0)', "hard_hit": "hard / nullif(tracked, 0)",
    "exit_speed": "speed_sum / nullif(tracked, 0)", "xrv": "xrv_sum / nullif(xrv_n, 0)",
}
over_pitches(
    "pitch_family_table",
    f"""SELECT BatterTeam, {n("lv", "level")}, CASE WHEN lv = 0 THEN 'All' ELSE family END AS family, sub, {n("n", "n")}, {", ".join(r(v, k) for k, v in RATES.items())}
    FROM (SELECT BatterTeam, family, sub, 2 - (grouping(family) + grouping(sub)) AS lv, {SUMS} FROM (SELECT * REPLACE (coalesce(sub, '?') AS sub) FROM named WHERE PitcherThrows = 'Right')
      GROUP BY GROUPING SETS ((BatterTeam), (BatterTeam, family), (BatterTeam, family, sub)))""",
    TYPED,
)
over_pitches(
    "spray_points",
    f"""SELECT PitchUID, Batter, PlayResult, {n("i", "i")}, {r("2 * (1 - t) * t * 0.5 * Distance * sin(radians(Direction)) + t * t * Distance * sin(radians(Bearing))", "x")},
      {r("2 * (1 - t) * t * 0.5 * Distance * cos(radians(Direction)) + t * t * Distance * cos(radians(Bearing))", "y")}
    FROM (SELECT *, i / 17.0::DOUBLE AS t FROM pitches, range(18) g(i) WHERE PitchCall = 'InPlay' AND PlayResult IN ('Out','Single','Double','Triple','HomeRun'))""",
)
over_pitches(
    "launch_histogram",
    f"""SELECT BatterTeam, f AS family, {n("a", "angle_from")}, {n("count(*)", "n")}, CASE WHEN a < 10 THEN 'GB' WHEN a < 25 THEN 'LD' WHEN a < 50 THEN 'FB' ELSE 'PU' END AS band
    FROM (SELECT BatterTeam, unnest(['All', family]) AS f, (least(floor((Angle + 90) / 5), 35) * 5 - 90)::INT AS a FROM named WHERE PitchCall = 'InPlay' AND Angle BETWEEN -90 AND 90) GROUP BY BatterTeam, f, a""",
    TYPED,
)


def histogram(key: str, where: str, value: str) -> str:
    return f""", spots AS (SELECT {key} AS k, least(floor((PlateLocSide + 2) * 23 / 4), 22)::INT AS ix, least(floor((PlateLocHeight - 0.5) * 23 / 4), 22)::INT AS iy, {value} AS v,
      PlateLocSide BETWEEN -2 AND 2 AND PlateLocHeight BETWEEN 0.5 AND 4.5 AS seen FROM named WHERE loc AND ({where})),
    cells_ AS (SELECT k, ix, iy, count(*) AS n, sum(v) AS total FROM spots WHERE seen GROUP BY ALL)"""


WHIFFED = "CASE WHEN PitchCall = 'StrikeSwinging' THEN 1.0::DOUBLE ELSE 0.0 END"
over_pitches("location_histogram", f"SELECT k AS PitcherTeam, {n('ix', 'ix')}, {n('iy', 'iy')}, {n('n', 'n')}, {r('total', 'total')} FROM cells_", TYPED + histogram("PitcherTeam", "sw", WHIFFED))
#: Kernel weights from a source cell to a target cell: offsets -5..5, mirrored at the half cell beyond each edge.
KERNEL = """, taps AS (SELECT o, exp(-0.5 * (o / 1.3::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (q / 1.3::DOUBLE) ** 2)) FROM range(-5, 6) h(q)) AS w FROM range(-5, 6) g(o)),
kernel AS (SELECT d, CASE WHEN d + o < 0 THEN -1 - d - o WHEN d + o > 22 THEN 45 - d - o ELSE d + o END AS s, sum(w) AS w FROM range(23) g(d), taps GROUP BY ALL)"""


def surface(key: str, where: str, value: str, scale: int, name: str = "") -> str:
    own = histogram(key, where, value) + KERNEL
    return f"""WITH {pitches_cte()}{TYPED}{own}
    SELECT k AS {key}, {n("ix", "ix")}, {n("iy", "iy")}, {r("-2 + (ix + 0.5::DOUBLE) * 4 / 23", "x")}, {r("0.5::DOUBLE + (iy + 0.5::DOUBLE) * 4 / 23", "y")}, {r(f"CASE WHEN n > 0.4 THEN total / n * {scale} END", "z")}{name}
    FROM (SELECT k, kx.d AS ix, ky.d AS iy, sum(n * kx.w * ky.w) AS n, sum(total * kx.w * ky.w) AS total FROM cells_ JOIN kernel kx ON kx.s = ix JOIN kernel ky ON ky.s = iy
      WHERE k IN (SELECT k FROM spots GROUP BY k HAVING count(*) >= 15) GROUP BY k, kx.d, ky.d)"""


ORACLES["rate_surface_smoothed"] = surface("PitcherTeam", "sw", WHIFFED, 100)
ORACLES["batter_surfaces"] = " UNION ALL ".join(
    f"SELECT * FROM ({s})"
    for s in (
        surface("BatterTeam", "family = 'Fastballs' AND PitchCall = 'InPlay' AND ExitSpeed IS NOT NULL", "ExitSpeed", 1, ", 'exit_speed' AS stat"),
        surface("BatterTeam", "family = 'Fastballs' AND NOT iz", "CASE WHEN sw THEN 1.0::DOUBLE ELSE 0.0 END", 100, ", 'chase' AS stat"),
    )
)
over_pitches(
    "pitch_density_kde",
    f"""SELECT Level, {n("ix", "ix")}, {n("iy", "iy")}, {r("any_value(gx)", "x")}, {r("any_value(gy)", "y")},
      {r("sum(exp(-0.5 * ((gx - px) ** 2 * vy - 2 * (gx - px) * (gy - py) * vxy + (gy - py) ** 2 * vx) / (det * f2))) / any_value(n * 2 * pi() * sqrt(det) * f2)", "z")}
    FROM (SELECT Level, PlateLocSide AS px, PlateLocHeight AS py FROM named WHERE loc)
    JOIN (SELECT *, vx * vy - vxy * vxy AS det, n ** (-1 / 3.0::DOUBLE) AS f2 FROM (SELECT Level, count(*)::DOUBLE AS n, var_samp(PlateLocSide) AS vx, var_samp(PlateLocHeight) AS vy, covar_samp(PlateLocSide, PlateLocHeight) AS vxy FROM named WHERE loc GROUP BY Level)) USING (Level),
    (SELECT ix, iy, -2 + ix * 4 / 69.0::DOUBLE AS gx, 0.5::DOUBLE + iy * 4 / 69.0::DOUBLE AS gy FROM range(70) a(ix), range(70) b(iy)) GROUP BY Level, ix, iy""",
    TYPED,
)
over_pitches(
    "velocity_kde",
    f"""SELECT PitcherTeam, TaggedPitchType, {n("i", "i")}, {r("any_value(speed)", "speed")}, {r("sum(z)", "z")} FROM (
      SELECT PitcherTeam, unnest([TaggedPitchType, 'All']) AS TaggedPitchType, i, speed, exp(-0.5 * ((speed - RelSpeed) / (sd * n ** -0.2::DOUBLE)) ** 2) / (sd * n ** -0.2::DOUBLE * sqrt(2 * pi())) / al * 100 AS z
      FROM kept JOIN (SELECT PitcherTeam, TaggedPitchType, count(*)::DOUBLE AS n, stddev_samp(RelSpeed) AS sd FROM kept GROUP BY ALL HAVING count(*) >= 5 AND sd > 1e-6) USING (PitcherTeam, TaggedPitchType)
      JOIN (SELECT PitcherTeam, count(*)::DOUBLE AS al, i, min(RelSpeed) - 3 + i * (max(RelSpeed) - min(RelSpeed) + 6) / 249 AS speed FROM kept, range(250) g(i) GROUP BY PitcherTeam, i HAVING count(*) >= 5) USING (PitcherTeam)
    ) GROUP BY ALL""",
    ", kept AS (SELECT * FROM pitches WHERE TaggedPitchType NOT IN ('Undefined', 'Other') AND RelSpeed IS NOT NULL)",
)

# Serving ------------------------------------------------------------------------------------------

INDEX = """, index_ AS (SELECT DISTINCT part AS Part, Level, League, PitcherTeam AS Team, Pitcher AS Player, substr(Date, 1, 4) AS Year FROM pitches WHERE Pitcher IS NOT NULL AND length(Date) >= 4),
bindex AS (SELECT DISTINCT part AS Part, Level, League, BatterTeam AS Team, Batter AS Player, substr(Date, 1, 4) AS Year FROM pitches WHERE Batter IS NOT NULL AND length(Date) >= 4),
teams AS (SELECT 'T' || n_nationkey AS acronym, CASE WHEN n_nationkey % 4 = 0 THEN '?' || n_name ELSE n_name END AS team_name, 'C' || n_regionkey AS conference FROM nation),
labels_ AS (SELECT acronym, CASE WHEN starts_with(team_name, '?') THEN acronym ELSE team_name END AS label FROM teams)"""
over_pitches("picker_index", "SELECT * FROM index_", INDEX)
over_pitches("index_stats", f"SELECT {n('count(*)', 'combos')}, {n('count(DISTINCT Player)', 'players')}, {n('count(DISTINCT Team)', 'teams')}, {n('count(DISTINCT Level)', 'levels')} FROM bindex", INDEX)
over_pitches("scope_cascade", f"SELECT i.*, conference AS Conference FROM index_ i JOIN teams ON acronym = Team WHERE Year IN ('1995', '1996') AND League IN {POOLED} AND conference = 'C1'", INDEX)
over_pitches("team_options", "SELECT DISTINCT Team AS acronym, coalesce(label, Team) AS label FROM index_ LEFT JOIN labels_ ON acronym = Team", INDEX)
over_pitches(
    "player_search",
    """SELECT name, role, school FROM (SELECT * FROM (SELECT DISTINCT 0 AS place, trim(Player) AS name, 'pitcher' AS role, coalesce(label, Team) AS school, Player, Team FROM index_ LEFT JOIN labels_ ON acronym = Team
      WHERE contains(lower(Player || ' ' || coalesce(label, '')), '1') AND contains(lower(Player || ' ' || coalesce(label, '')), 'nation_1') ORDER BY Player, Team LIMIT 20)
    UNION ALL SELECT * FROM (SELECT DISTINCT 1, trim(Player), 'batter', coalesce(label, Team), Player, Team FROM bindex LEFT JOIN labels_ ON acronym = Team
      WHERE contains(lower(Player || ' ' || coalesce(label, '')), '1') AND contains(lower(Player || ' ' || coalesce(label, '')), 'nation_1') ORDER BY Player, Team LIMIT 20)) ORDER BY place, name, school LIMIT 20""",
    INDEX,
)
over_pitches("level_filter_pooled", f"SELECT League, Level, {n('count(*)', 'n')} FROM pitches WHERE League IN {POOLED} GROUP BY ALL")
over_pitches("player_rows", f"SELECT PitchUID, substr(Date, 1, 4) AS Year, TaggedPitchType, {r('RelSpeed', 'RelSpeed')} FROM pitches WHERE Pitcher = 'Supplier#000000001' AND substr(Date, 1, 4) IN ('1995', '1996')")
over_pitches("retag_overlay", f"SELECT CASE WHEN PitchNo = 3 AND length(PitchUID) % 3 <> 1 THEN 'Sweeper' ELSE TaggedPitchType END AS TaggedPitchType, {n('count(*)', 'n')} FROM pitches GROUP BY 1")
over_pitches(
    "cluster_overlay",
    f"SELECT CASE WHEN PitchNo % 2 = 1 THEN 'Unclustered' WHEN PitchNo % 3 = 0 THEN 'Heater' ELSE 'Cluster ' || (PitchNo % 3) END AS TaggedPitchType, {n('count(*)', 'n')}, {r('avg(CASE WHEN PitchNo % 2 = 0 THEN (PitchNo % 10) / 10 END)', 'conf')} FROM pitches GROUP BY 1",
)
over_pitches(
    "unsure_queue",
    f"SELECT PitchUID, {r('RelSpeed', 'RelSpeed')}, {r('SpinRate', 'SpinRate')}, {r('InducedVertBreak', 'InducedVertBreak')}, {r('HorzBreak', 'HorzBreak')}, {n('PitchNo % 3', 'cluster')}, {r('(PitchNo % 10) / 10', 'conf')} FROM pitches WHERE PitchNo % 2 = 0 AND PitchNo <> 4 AND PitchNo % 10 < 7",
)


def pool(where: str) -> str:
    return f""", flagged_ AS (SELECT Pitcher, PitchofPA = 1 AS pa, KorBB = 'Strikeout' AS k, KorBB = 'Walk' AS bb, coalesce(OutsOnPlay, 0) AS oop,
      CASE WHEN TaggedPitchType IN ('Fastball','FourSeamFastBall','TwoSeamFastBall','OneSeamFastBall','Sinker') THEN RelSpeed END AS fb, Extension AS e, PitchCall IN {SWING} AS sw, PitchCall = 'StrikeSwinging' AS wh,
      PlateLocSide IS NOT NULL AND PlateLocHeight IS NOT NULL AND NOT (abs(PlateLocSide) <= 0.83 AND PlateLocHeight BETWEEN 1.5 AND 3.3775) AS oz, CASE WHEN PitchCall = 'InPlay' THEN ExitSpeed END AS bbe,
      PitchCall = 'InPlay' AND ExitSpeed >= 98 AND Angle >= greatest(8::DOUBLE, 26 - (ExitSpeed - 98)) AND Angle <= least(50::DOUBLE, 30 + (ExitSpeed - 98) * 20.0::DOUBLE / 18.0::DOUBLE) AS barrel,
      PitchCall = 'InPlay' AND TaggedHitType IN ('GroundBall','FlyBall','LineDrive','Popup') AS bip, PitchCall = 'InPlay' AND TaggedHitType = 'GroundBall' AS gb FROM pitches WHERE {where}),
    pool_ AS (SELECT *, outs >= 60 AS qualified, k / nullif(bf, 0) AS k_pct, bb / nullif(bf, 0) AS bb_pct FROM (SELECT Pitcher, count(*) AS n_pitches, count(*) FILTER (pa) AS bf, count(*) FILTER (k) AS k, count(*) FILTER (bb) AS bb,
      sum(oop) + count(*) FILTER (k) AS outs, avg(fb) AS fb_velo, avg(e) AS ext, avg(bbe) AS avg_ev, count(*) FILTER (bbe >= 95) / nullif(count(bbe), 0) AS hardhit, count(*) FILTER (barrel) / nullif(count(bbe), 0) AS barrel,
      count(*) FILTER (gb) / nullif(count(*) FILTER (bip), 0) AS gb, count(*) FILTER (wh) / nullif(count(*) FILTER (sw), 0) AS whiff, count(*) FILTER (oz AND sw) / nullif(count(*) FILTER (oz), 0) AS chase FROM flagged_ GROUP BY Pitcher))"""


RATED = ["fb_velo", "ext", "avg_ev", "hardhit", "barrel", "gb", "whiff", "chase", "k_pct", "bb_pct"]
over_pitches("percentile_pool", f"SELECT Pitcher, {', '.join(n(c, c) for c in ('n_pitches', 'bf', 'k', 'bb', 'outs'))}, {', '.join(r(c, c) for c in RATED)}, qualified FROM pool_", pool(f"League IN {POOLED}"))
over_pitches(
    "percentile_ranks",
    " UNION ALL ".join(
        f"""SELECT Pitcher, '{c}' AS metric, {r(f"(SELECT CASE WHEN count(*) >= 10 THEN greatest(1, least(99.4::DOUBLE, {'' if up else '100 - '}100 * (count(*) FILTER (q.{c} < p.{c}) + 0.5::DOUBLE * count(*) FILTER (q.{c} = p.{c})) / count(*))) END FROM pool_ q WHERE q.qualified AND q.{c} IS NOT NULL)", "percentile")}
        FROM pool_ p WHERE {c} IS NOT NULL"""
        for c, up in zip(["fb_velo", "avg_ev", "chase", "whiff", "k_pct", "bb_pct", "barrel", "hardhit", "gb", "ext"], [1, 0, 1, 1, 1, 0, 0, 0, 1, 1], strict=True)
    ),
    pool("true").replace("pool_ AS", "exact AS") + ", pool_ AS (SELECT Pitcher, qualified, " + ", ".join(r(c, c) for c in RATED) + " FROM exact)",
)

# Biography ----------------------------------------------------------------------------------------

UNIVERSE = """, seen AS (SELECT Batter AS Name, coalesce(BatterId, '') AS TrackManId, BatterTeam AS t, Level, Date FROM pitches UNION ALL SELECT Pitcher, coalesce(PitcherId, ''), PitcherTeam, Level, Date FROM pitches),
universe AS (SELECT Name, TrackManId, min(substr(Date, 1, 4)::INT) AS first_year, max(substr(Date, 1, 4)::INT) AS last_year, list_sort(list(DISTINCT t)) AS teams, bool_or(Level = 'D1') AS is_d1, max(Date) AS last_seen FROM seen GROUP BY 1, 2)"""
BIO = """, own AS (SELECT c_name AS Name, CASE WHEN c_custkey % 23 <> 0 THEN c_custkey::VARCHAR ELSE '' END AS TrackManId, c_custkey % 20 + 60 AS HeightIn,
  CASE c_custkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'no_height' ELSE 'found' END AS Status, c_custkey AS seq FROM customer WHERE c_custkey % 3 < 2),
bio AS (SELECT * FROM own UNION ALL SELECT Name, TrackManId, HeightIn + 1, 'manual', seq + 10000000 FROM own WHERE seq % 7 = 0),
newest AS (SELECT * FROM bio QUALIFY row_number() OVER (PARTITION BY Name, TrackManId ORDER BY seq DESC) = 1)"""
over_pitches("player_universe", f"SELECT Name, TrackManId, {n('first_year', 'first_year')}, {n('last_year', 'last_year')}, array_to_string(teams, ',') AS teams, is_d1, last_seen FROM universe", UNIVERSE)
over_pitches("bio_latest_wins", f"SELECT Name, TrackManId, {n('HeightIn', 'HeightIn')}, Status, seq FROM newest", BIO)
over_pitches(
    "pending_players",
    "SELECT Name, TrackManId, is_d1, last_seen FROM universe u WHERE NOT EXISTS (SELECT 1 FROM newest b WHERE b.Name = u.Name AND b.TrackManId = u.TrackManId AND b.Status NOT IN ('not_found', 'ambiguous', 'no_height'))",
    UNIVERSE + BIO,
)
over_pitches(
    "bio_lookup_fallback",
    f"""SELECT p.Name, p.TrackManId, {n("CASE WHEN b.Name IS NOT NULL THEN b.HeightIn ELSE (SELECT arg_min(x.HeightIn, (SELECT min(seq) FROM bio y WHERE y.Name = x.Name AND y.TrackManId = x.TrackManId)) FROM newest x WHERE x.Name = p.Name) END", "HeightIn")}
    FROM (SELECT DISTINCT Name, CASE WHEN length(Name) % 2 = 0 THEN 'x' ELSE TrackManId END AS TrackManId FROM universe) p LEFT JOIN newest b ON b.Name = p.Name AND b.TrackManId = p.TrackManId""",
    UNIVERSE + BIO,
)
ORACLES["year_overlap_candidates"] = f"""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 > 0 THEN 1995 END AS f, CASE WHEN c_custkey % 9 > 0 THEN 1995 + c_custkey % 3 END AS l, i FROM customer, range(3) g(i) WHERE (c_custkey + i) % 4 <> 0),
d AS (SELECT *, i < 2 AS same, CASE WHEN (k + i) % 5 > 0 THEN 1990 + (k * 3 + i * 2) % 11 END AS y0, CASE WHEN (k + i) % 5 > 0 THEN 1990 + (k * 3 + i * 2) % 11 + i END AS y1 FROM c),
e AS (SELECT *, bool_or(same) OVER (PARTITION BY k) AS any_same FROM d)
SELECT 'Van  Last, C.' || k AS Name, k::VARCHAR AS TrackManId, i::VARCHAR AS url, {n("count(*) OVER (PARTITION BY k)", "n_candidates")} FROM e
WHERE (same OR (NOT any_same AND contains('jr c' || k || ' van last', 'c' || k || ' van last'))) AND (y0 IS NULL OR l IS NULL OR (y0 - 1 <= l AND y1 + 1 >= f))
"""
ORACLES["draft_eligibility"] = f"""
WITH b AS (SELECT DISTINCT o_orderdate::DATE AS born FROM orders),
d AS (SELECT born, CASE year(born) + 21 WHEN 2022 THEN DATE '2022-07-17' WHEN 2023 THEN DATE '2023-07-09' WHEN 2024 THEN DATE '2024-07-14' WHEN 2025 THEN DATE '2025-07-13' WHEN 2026 THEN DATE '2026-07-12'
  ELSE make_date(year(born) + 21, 7, 1) + ((7 - isodow(make_date(year(born) + 21, 7, 1))) % 7 + 7)::INT END AS draft FROM b)
SELECT strftime(born, '%Y-%m-%d') AS born, strftime(draft, '%Y-%m-%d') AS draft, {r("(draft - born) / 365.25::DOUBLE", "age")},
  CASE WHEN month(born) = 2 AND day(born) = 29 THEN make_date(year(born) + 21, 3, 1) ELSE make_date(year(born) + 21, month(born), day(born)) END <= draft + 45 AS eligible FROM d
"""
ORACLES["name_normalise"] = "SELECT s_suppkey, 'J. ' || s_suppkey || ' ' || s_name || ' Jr.' AS search, 'j ' || s_suppkey || ' ' || lower(s_name) || ' jr' AS normal FROM supplier"
ORACLES["height_parse"] = f"""
SELECT s_suppkey, {n("CASE s_suppkey % 3 WHEN 0 THEN (5 + s_suppkey % 2) * 12 + s_suppkey % 12 WHEN 1 THEN round_even((160 + s_suppkey % 40) / 2.54::DOUBLE, 0) END", "inches")},
  {n("CASE WHEN s_suppkey % 3 = 0 AND 150 + s_suppkey >= 0 THEN 150 + s_suppkey END", "pounds")},
  {n("CASE WHEN t BETWEEN 40 AND 90 THEN t END", "typed")} FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN (5 + s_suppkey % 2) * 12 + s_suppkey % 12 ELSE s_suppkey % 100 END AS t FROM supplier)
"""

# Scouting -----------------------------------------------------------------------------------------

VERSIONS = """v AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'id:' || (conv_id % 40) ELSE 'name:player-' || (conv_id % 30) END AS player_key, 'P ' || (conv_id % 40) AS player_name,
  CASE WHEN conv_id % 2 = 0 THEN 'pitcher' ELSE 'batter' END AS role, 'School' AS school, 'pos' || (turn % 3) AS position, CASE WHEN conv_id % 5 > 0 THEN 40 + (conv_id + turn) % 30 END AS ovr, 'A' || (conv_id % 3) AS author,
  CASE WHEN conv_id % 4 > 0 THEN conv_id % 3 END AS author_id, CASE WHEN conv_id % 11 = 0 AND turn > 0 THEN 1 ELSE 0 END AS deleted, '2026-01-' || lpad((1 + turn % 28)::VARCHAR, 2, '0') AS created_at FROM conversations),
t AS (SELECT *, CASE author_id WHEN 0 THEN 'Zed' WHEN 1 THEN 'amy' END AS author_name FROM (SELECT *, coalesce('a' || author_id, 'legacy:' || coalesce(author, '')) AS thread FROM v)
  QUALIFY row_number() OVER (PARTITION BY player_key, thread ORDER BY created_at DESC, id DESC) = 1),
live AS (SELECT * FROM t WHERE deleted = 0),
short AS (SELECT player_key, arg_max(player_name, (created_at, id)) AS player_name, arg_max(role, (created_at, id)) AS role, arg_max(school, (created_at, id)) AS school, arg_max(position, (created_at, id)) AS position, count(*) AS reports,
  max(ovr) AS hi, min(ovr) AS lo, string_agg(coalesce(author_name, author, '—'), ', ' ORDER BY created_at DESC, id DESC) AS authors_label FROM live GROUP BY player_key)"""
SHORT = f"SELECT player_key, player_name, role, school, position, {n('reports', 'reports')}, {n('hi', 'ovr_max')}, CASE WHEN hi IS NULL THEN '' WHEN hi = lo THEN hi::VARCHAR ELSE lo || '–' || hi END AS ovr_label, authors_label FROM short"
ORACLES["latest_threads"] = f"WITH {VERSIONS} SELECT player_key, thread, id, {n('ovr', 'ovr')}, author_name FROM live"
ORACLES["shortlist_rollup"] = f"WITH {VERSIONS} {SHORT}"
ORACLES["shortlist_search"] = f"WITH {VERSIONS} {SHORT} WHERE contains(lower(player_name || chr(10) || school || chr(10) || position || chr(10) || authors_label), 'zed')"
ORACLES["thread_history"] = f"WITH {VERSIONS} SELECT id, created_at, position FROM v WHERE player_key = 'id:2' AND author_id = 2 AND deleted = 0"

# Ingest -------------------------------------------------------------------------------------------

RAW = """raw AS (SELECT 'f' || (l_orderkey % 50) || '.csv' AS file_name, l_partkey AS k,
  CASE WHEN l_partkey % 97 = 0 OR l_partkey % 89 = 0 THEN NULL ELSE l_partkey % 30 END AS PitchNo, CASE WHEN l_partkey % 301 = 0 THEN 9 ELSE l_partkey % 3 END AS Outs, CASE WHEN l_partkey % 401 <> 0 THEN l_partkey % 4 END AS Balls,
  CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 79 = 0 THEN 88.5::DOUBLE ELSE 80 + l_partkey % 20 END AS RelSpeed,
  CASE WHEN l_partkey % 71 = 0 THEN 'InPlay' WHEN l_partkey % 73 = 0 THEN 'Undefined' WHEN l_partkey % 499 = 0 THEN 'Bunt?' ELSE 'InPlay' END AS PitchCall, CASE WHEN l_partkey % 67 = 0 THEN 'Strikeout' ELSE 'Undefined' END AS KorBB FROM lineitem),
sound AS (SELECT *, (Balls IS NULL)::INT AS b1, (PitchCall = 'Bunt?')::INT AS b2 FROM raw WHERE Outs BETWEEN 0 AND 2)"""
ORACLES["typed_cast_failures"] = f"WITH {RAW} SELECT file_name, 'PitchNo' AS \"column\", {n('count(*)', 'n')} FROM raw WHERE PitchNo IS NULL GROUP BY 1 UNION ALL SELECT file_name, 'RelSpeed', count(*) FROM raw WHERE RelSpeed IS NULL GROUP BY 1"
ORACLES["value_remap"] = f"WITH {RAW} SELECT PitchCall, KorBB, {n('count(*)', 'n')} FROM raw GROUP BY ALL"
ORACLES["validation_summary"] = f"WITH {RAW} SELECT * FROM (SELECT 'Balls' AS \"column\", 'not_null' AS \"check\", {n('sum(b1)', 'n')} FROM sound UNION ALL SELECT 'PitchCall', 'isin', sum(b2)::BIGINT FROM sound) WHERE n > 0"
ORACLES["range_quarantine"] = f"WITH {RAW} SELECT file_name, {n('count(*)', 'n')}, {r('avg(RelSpeed)', 'speed')} FROM sound GROUP BY file_name HAVING sum(b1 + b2) = 0"
ORACLES["missing_column_pad"] = f"WITH {RAW} SELECT {n('count(*)', 'n')}, {n('0', 'exit_speed')}, {n('0', 'notes')}, {n('202', 'width')}, {n('count(RelSpeed)', 'rel_speed')} FROM raw"

# Models -------------------------------------------------------------------------------------------

over_pitches(
    "stratified_folds",
    f"SELECT PlayResult, {n('f', 'fold')}, {n('count(*)', 'n')} FROM (SELECT PlayResult, (row_number() OVER (PARTITION BY PlayResult ORDER BY md5(PitchUID), PitchUID) - 1) % 5 AS f FROM pitches WHERE Level = '{LEVEL}' AND file_year = '{YEAR}' AND {BATTED}) GROUP BY ALL",
)
ORACLES["knn_label_proba"] = f"""
WITH e AS (SELECT vec_id AS id, label % 5 AS label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
near AS (SELECT q.id, r.label FROM e q, e r QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY (q.a - r.a) ** 2 + (q.b - r.b) ** 2 + (q.c - r.c) ** 2, r.id) <= 5)
SELECT id, {", ".join(r(f"(count(*) FILTER (label = {i}) + 0.5::DOUBLE) / (count(*) + 2.5::DOUBLE)", f"p_{o}") for i, o in enumerate(("Out", "Single", "Double", "Triple", "HomeRun")))} FROM near GROUP BY id
"""
ORACLES["log_loss"] = f"SELECT l_returnflag, {r('-avg(ln((l_quantity + 1) / 52))', 'loss')} FROM lineitem GROUP BY 1"
over_pitches("min_group_count", f"SELECT Pitcher, {n('count(*)', 'n')} FROM pitches GROUP BY Pitcher HAVING count(*) >= 300")
over_pitches("mirror_left", f"SELECT PitcherThrows, {r('avg(CASE WHEN PitcherThrows = $$Left$$ THEN -HorzBreak ELSE HorzBreak END)', chr(34) + 'break' + chr(34))}, {n('count(*)', 'n')} FROM pitches GROUP BY 1")
over_pitches(
    "decision_filter",
    f"""SELECT f AS family, {n("count(*)", "n")}, {r("avg((PitchCall IN ('StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay','FoulBall'))::INT)", "swung")}, {r("avg((PitchCall = 'StrikeCalled')::INT)", "called")}
    FROM (SELECT *, CASE WHEN AutoPitchType IN ('Four-Seam','Sinker') THEN 'Fastball' WHEN AutoPitchType IN ('Cutter','Slider','Curveball') THEN 'Breaking' WHEN AutoPitchType IN ('Changeup','Splitter') THEN 'Offspeed' ELSE 'Unknown' END AS f FROM pitches
      WHERE PitchCall IN ('StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay','FoulBall','StrikeCalled','BallCalled','BallinDirt') AND BatterSide IN ('Left','Right') AND abs(PlateLocSide) <= 3
        AND PlateLocHeight BETWEEN 0 AND 5.5 AND AutoPitchType <> 'Other') GROUP BY f""",
)

# Operators that other queries use or that stand alone -------------------------------------------------

DECISIONS = """(SELECT *, CASE WHEN AutoPitchType IN ('Four-Seam','Sinker') THEN 'Fastball' WHEN AutoPitchType IN ('Cutter','Slider','Curveball') THEN 'Breaking' WHEN AutoPitchType IN ('Changeup','Splitter') THEN 'Offspeed' ELSE 'Unknown' END AS family FROM {source}
      WHERE PitchCall IN ('StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay','FoulBall','StrikeCalled','BallCalled','BallinDirt') AND BatterSide IN ('Left','Right') AND abs(PlateLocSide) <= 3
        AND PlateLocHeight BETWEEN 0 AND 5.5 AND AutoPitchType <> 'Other')"""
over_pitches(
    "swing_run_values",
    f"""SELECT family, {n("Balls", "Balls")}, {n("Strikes", "Strikes")}, {n("count(*)", "n")}, {r("avg(run_delta)", "run_value")} FROM {DECISIONS.format(source="valued")}
    WHERE run_delta IS NOT NULL AND PitchCall IN ('StrikeSwinging','FoulBallNotFieldable','FoulBallFieldable','InPlay','FoulBall') GROUP BY ALL""",
    MATRIX + CELLS + delta("GameUID", "pitches"),
)
over_pitches(
    "calibration_bins",
    f"""SELECT {n("b", "bin")}, {n("count(*)", "n")}, {r("avg(p)", "predicted")}, {r("avg((PitchCall = 'StrikeCalled')::INT)", "seen")}
    FROM (SELECT *, PlateLocHeight / 5.5::DOUBLE AS p, least(floor(PlateLocHeight / 5.5::DOUBLE * 15), 14) AS b FROM {DECISIONS.format(source="pitches")}) GROUP BY b""",
)
over_pitches(
    "level_names",
    f"""SELECT {n("row_number() OVER (ORDER BY k) - 1", "place")}, level FROM (SELECT DISTINCT Level AS level, Level AS k FROM pitches WHERE Level IS NOT NULL
    UNION ALL SELECT 'P4', 'D1 pooled' WHERE EXISTS (SELECT 1 FROM pitches WHERE League IN {POOLED}))""",
)
over_pitches("year_options", "SELECT DISTINCT Year FROM bindex", INDEX)
over_pitches("conference_options", "SELECT DISTINCT conference AS Conference FROM index_ JOIN teams ON acronym = Team", INDEX)
over_pitches("player_options", "SELECT DISTINCT Player FROM bindex", INDEX)
ORACLES["called_strike_surface"] = surface("PitcherTeam", "PitchCall IN ('StrikeCalled', 'BallCalled')", "CASE WHEN PitchCall = 'StrikeCalled' THEN 1.0::DOUBLE ELSE 0.0 END", 100)
ORACLES["hard_hit_surface"] = surface("PitcherTeam", "ExitSpeed IS NOT NULL", "CASE WHEN ExitSpeed >= 95 THEN 1.0::DOUBLE ELSE 0.0 END", 100)
over_pitches("path_level_year", "SELECT DISTINCT part, file_year, part AS level, file_year AS year FROM pitches")
over_pitches(
    "pitch_display_names",
    f"""SELECT TaggedPitchType, {n("count(*)", "n")}, CASE TaggedPitchType WHEN 'FourSeamFastBall' THEN 'Four-Seam' WHEN 'TwoSeamFastBall' THEN 'Two-Seam' WHEN 'ChangeUp' THEN 'Changeup' ELSE TaggedPitchType END AS shown
    FROM pitches GROUP BY ALL""",
)
over_pitches("plausible_names", "SELECT DISTINCT 'Last, F' || Pitcher AS Name FROM pitches")
ORACLES["name_resolution"] = """
SELECT c_name AS Name, c_custkey::VARCHAR AS TrackManId, CASE WHEN c_custkey % 10 = 0 THEN 'ambiguous' WHEN c_custkey % 5 < 2 THEN 'unique' ELSE 'not_found' END AS status FROM customer
"""
ORACLES["report_authors"] = f"WITH {VERSIONS} SELECT trim(author) AS initials, arg_max(coalesce(author_name, trim(author)), (created_at, id)) AS name FROM live WHERE trim(coalesce(author, '')) <> '' GROUP BY trim(author)"
over_pitches(
    "hand_assignments",
    f"""SELECT {n("c", "cluster")}, {n("count(*)", "n")}, {r("avg(f)", "conf")} FROM (
      SELECT CASE WHEN PitchNo % 6 = 0 THEN 9 ELSE PitchNo % 3 END AS c, CASE WHEN PitchNo % 6 = 0 THEN 1.0::DOUBLE ELSE (PitchNo % 10) / 10.0::DOUBLE END AS f FROM pitches WHERE PitchNo % 2 = 0) GROUP BY c""",
)
over_pitches(
    "cluster_summary",
    f"""SELECT Pitcher, {n("PitchNo % 3", "cluster")}, {n("count(*)", "n")}, {r("avg(RelSpeed)", "RelSpeed")}, {r("avg(CASE WHEN PitcherThrows = 'Left' THEN -HorzBreak ELSE HorzBreak END)", "HorzBreak")}, {n("any_value(un)", "n_unclustered")}
    FROM pitches JOIN (SELECT Pitcher, count(*) FILTER (PitchNo % 2 = 1) AS un FROM pitches GROUP BY Pitcher) USING (Pitcher) WHERE PitchNo % 2 = 0 GROUP BY Pitcher, PitchNo % 3""",
)
ORACLES["report_ages"] = f"""
SELECT BirthDate, {r("round(datediff('day', BirthDate::DATE, DATE '2019-07-14') / 365.25::DOUBLE + 1e-12, 1)", "age")},
  CASE WHEN strftime(BirthDate::DATE, '%m-%d') = '02-29' THEN make_date(year(BirthDate::DATE) + 21, 3, 1) ELSE (BirthDate::DATE + INTERVAL 21 YEAR)::DATE END <= DATE '2019-07-14' + 45 AS eligible
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS BirthDate FROM orders)
"""
over_pitches(
    "attached_run_values",
    f"""SELECT Level, substr(Date, 1, 4) AS year, {n("count(*)", "n")}, {n("count(*) FILTER (hit)", "scored")}, {r("max(CASE WHEN hit THEN (1.5 * 0 + 0.5 * (1 + 2 + 3 + 4)) / 3.5::DOUBLE END)", "xRV")}
    FROM (SELECT *, Level = 'D1' AND substr(Date, 1, 4) = '{YEAR}' AND PitchCall = 'InPlay' AND ExitSpeed IS NOT NULL AND Angle IS NOT NULL AND Direction IS NOT NULL AS hit FROM pitches) GROUP BY ALL""",
)
