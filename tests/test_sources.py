"""Raw files with three header widths, quarantine, the served tree and its compaction."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from diamondlake.schema import COLUMNS, OPTIONAL, PITCH, REQUIRED
from diamondlake.sources import ingest, layout

SOUND = {
    "PitchCall": "InPlay", "KorBB": "Undefined", "TaggedHitType": "Undefined", "PlayResult": "Out", "PitcherSet": "Undefined", "TaggedPitchType": "Fastball",
    "Top/Bottom": "Top", "Outs": "1", "Balls": "2", "Strikes": "1", "Inning": "3", "OutsOnPlay": "1", "RunsScored": "0", "PitchofPA": "2", "RelSpeed": "91.5", "Level": "D1", "Date": "2024-04-01",
}


def write(path, name, columns, *rows):
    lines = [",".join(columns)] + [",".join(({c: "x" for c in REQUIRED} | SOUND | r).get(c, "") for c in columns) for r in rows]
    (path / name).write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    core = [c for c in COLUMNS if c not in OPTIONAL]
    bat = [*core, "BatSpeed", "VerticalAttackAngle", "HorizontalAttackAngle"]
    write(path, "20240401-a.csv", core, {"PitchNo": "1"}, {"PitchNo": "3.0"}, {"PitchNo": "abc"})
    write(path, "20240402-b.csv", bat, {"BatSpeed": "70", "PitchCall": "Inplay"}, {"Outs": "3"})
    write(path, "20240403-c.csv", [*reversed(COLUMNS), "Extra"], {"SpinAxis3dTilt": "1:15", "Extra": "gone"})
    write(path, "20240404-d.csv", core, {"Outs": ""}, {})
    write(path, "20240405-e.csv", core, {"PitchCall": "Bunted"})
    return str(path)


def test_ingest(spark, raw):
    out = ingest.ingest(spark, raw)
    clean = out["clean"].collect()
    assert out["clean"].columns == ["file_name", *COLUMNS]
    assert sorted(r["file_name"] for r in clean) == ["20240401-a.csv"] * 3 + ["20240402-b.csv", "20240403-c.csv"]
    assert {r["PitchNo"] for r in clean if r["file_name"] == "20240401-a.csv"} == {1, None}
    assert [(r["BatSpeed"], r["PitchCall"]) for r in clean if r["file_name"] == "20240402-b.csv"] == [(70.0, "InPlay")]
    assert [(r["SpinAxis3dTilt"], r["RelSpeed"]) for r in clean if r["file_name"] == "20240403-c.csv"] == [("1:15", 91.5)]
    assert {tuple(r) for r in out["cast_failures"].collect()} == {("20240401-a.csv", "PitchNo", 2)}
    assert {tuple(r) for r in out["violations"].collect()} == {("20240404-d.csv", "Outs", "not_null", 1), ("20240405-e.csv", "PitchCall", "isin", 1)}
    assert {tuple(r) for r in ingest.tally(out["status"]).collect()} == {("success", 3), ("quarantined", 2)}
    again = ingest.ingest(spark, raw, out["status"].where("status = 'success'"))
    assert again["status"].count() == 2


def test_number_accepts_plain_numbers_only(spark):
    rows = spark.createDataFrame([("3.0",), (" 3",), ("1.5d",), ("",), (None,), ("7",)], "v string")
    kinds = {f.name: f.dataType for f in PITCH}
    got = rows.select(ingest.number(F.col("v"), kinds["PitchNo"]), ingest.number(F.col("v"), kinds["RelSpeed"])).collect()
    assert [tuple(r) for r in got] == [(None, 3.0), (3, 3.0), (None, None), (None, None), (None, None), (7, 7.0)]


def test_compaction(spark, tmp_path):
    def game(part, year, month, day, name, n):
        target = tmp_path / part / year / month / day
        target.mkdir(parents=True, exist_ok=True)
        spark.range(n).withColumn("game", F.lit(name)).toPandas().to_parquet(target / f"{name}.parquet")

    game("D1", "2023", "04", "01", "20230401-a", 3)
    game("D1", "2023", "05", "02", "20230502-b", 2)
    game("D1", "2024", "03", "01", "20240301-c", 4)
    game("D1", "2024", "03", "09", "20240309-d", 1)
    game("D1", "2024", "06", "01", "20240601-e", 5)
    game("Others", "2025", "01", "01", "20250101-f", 6)
    today = dt.date(2024, 6, 15)
    assert layout.compact(spark, str(tmp_path), today) == [("D1", "2023", 5), ("D1", "2024", 5)]
    left = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet"))
    assert left == ["D1/2023/d1_2023.parquet", "D1/2024/03/d1_2024_03.parquet", "D1/2024/06/01/20240601-e.parquet", "Others/2025/01/01/20250101-f.parquet"]
    assert [r["game"] for r in spark.read.parquet(str(tmp_path / "D1/2023/d1_2023.parquet")).collect()] == ["20230401-a"] * 3 + ["20230502-b"] * 2
    assert layout.compact(spark, str(tmp_path), today) == []
    game("D1", "2023", "05", "03", "20230503-late", 1)
    assert layout.compact(spark, str(tmp_path), today) == [("D1", "2023", 6)]


GAME = "file_name string, GameUID string, Level string, Inning long, PAofInning long, PitchofPA long, PitchNo long, PitchUID string, PlayResult string, ThrowSpeed double"


def served(spark, path):
    games = [("20230401-a", "D1"), ("20230517-b", "D1"), ("20240301-c", "D1"), ("20240309-d", "D1"), ("20240601-e", "D1"), ("20230402-f", "JUCO"), ("x", None)]
    rows = [(f"{n}.csv", n, lv, 1, 1, 1, i, f"{n}-{i}", "Out", None) for n, lv in games for i in range(4)]
    layout.write_tree(layout.routed(spark.createDataFrame(rows, GAME)), path)
    return rows


def content(spark, path):
    names = ["PitchUID", "part", "file_year", "month", "day"]
    return sorted(map(str, layout.read_tree(spark, path).select(names).collect()))


def test_the_engines_own_tree_is_compacted(spark, tmp_path):
    tree = str(tmp_path / "tree")
    served(spark, tree)
    before = content(spark, tree)
    today = dt.date(2024, 6, 15)
    assert layout.compact(spark, tree, today) == [("D1", "2023", 8), ("D1", "2024", 8), ("Others", "2023", 4)]
    left = sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*.parquet"))
    assert left[:2] == ["part=D1/file_year=2023/month=all/day=all/d1_2023.parquet", "part=D1/file_year=2024/month=03/day=all/d1_2024_03.parquet"] and len(left) == 5
    assert content(spark, tree) == before
    assert layout.compact(spark, tree, today) == []
    paths = spark.read.parquet(tree).select(layout.path_level_year(F.col("_metadata.file_path")).alias("x")).distinct().collect()
    assert {tuple(r["x"]) for r in paths} >= {("D1", "2023"), ("D1", "2024"), ("Others", "2023")}
    late = spark.createDataFrame([("20230518-late.csv", "g", "D1", 1, 1, 1, 1, "late", "Out", None)], GAME)
    layout.write_tree(layout.routed(late), tree)
    assert layout.compact(spark, tree, today) == [("D1", "2023", 9)] and len(content(spark, tree)) == len(before) + 1


def test_large_years_become_several_files(spark, tmp_path, monkeypatch):
    tree = str(tmp_path / "tree")
    served(spark, tree)
    before = content(spark, tree)
    monkeypatch.setattr(layout, "FILE_BYTES", 4000)
    layout.compact(spark, tree, dt.date(2025, 1, 1))
    names = sorted(p.name for p in (tmp_path / "tree/part=D1/file_year=2023").rglob("*.parquet"))
    assert len(names) > 1 and names[0] == "d1_2023-00000.parquet" and content(spark, tree) == before
    assert layout.compact(spark, tree, dt.date(2025, 1, 1)) == []


@pytest.mark.parametrize("step", ["note", "replace", "finish", "prune"])
def test_a_compaction_cut_short_is_finished(spark, tmp_path, monkeypatch, step):
    tree = str(tmp_path / "tree")
    served(spark, tree)
    before = content(spark, tree)
    done = getattr(layout.Tree, step)

    def cut(self, *args):
        done(self, *args) if step == "replace" else None
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(layout.Tree, step, cut)
        layout.compact(spark, tree, dt.date(2024, 6, 15))
    layout.compact(spark, tree, dt.date(2024, 6, 15))
    assert content(spark, tree) == before
    assert not [p for p in (tmp_path / "tree").iterdir() if p.name.startswith((".stage", ".compact", ".draft"))]


def test_tree_prunes(spark, tmp_path):
    rows = spark.createDataFrame([("20240401-a.csv", "G1", "D1", 1, 1, 1, 1, "u1", "Out", None), ("x.csv", "G2", None, 1, 1, 1, 1, "u2", "Out", None)],
        "file_name string, GameUID string, Level string, Inning long, PAofInning long, PitchofPA long, PitchNo long, PitchUID string, PlayResult string, ThrowSpeed double")
    layout.write_tree(layout.routed(rows), str(tmp_path / "tree"))
    tree = layout.read_tree(spark, str(tmp_path / "tree"))
    assert {(r["part"], r["file_year"], r["month"]) for r in tree.collect()} >= {("D1", "2024", "04")}
    assert [tuple(r) for r in layout.unknown_dates(tree).collect()] == [("Others", 1)]
    plan = tree.where("part = 'D1' AND file_year = '2024'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_stream_takes_each_file_once(spark, raw, tmp_path):
    from diamondlake.streaming import serve_games

    tree, state = str(tmp_path / "tree"), str(tmp_path / "state")
    for _ in range(2):
        serve_games(spark, raw, tree, state, files=2).awaitTermination()
    served = layout.read_tree(spark, tree)
    assert served.groupBy("file_name").count().count() == 3 and served.count() == 5
    assert served.where("base_state IS NULL").isEmpty()
