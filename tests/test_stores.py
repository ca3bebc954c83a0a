"""Append-only stores, stage runs, the stored matrix and index."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from diamondlake.adapter import pitches
from diamondlake.operators import bio, eye, gmm, runs, scouting, serving
from diamondlake.plans import stages
from diamondlake.sources import shared
from diamondlake.sources.stores import Clusters, Retags, retag_selection

SF = "/root/testdata/sf0.001"


def test_retags_are_set_taken_back_and_cleared(spark, tmp_path):
    store = Retags(spark, str(tmp_path))
    assert store.live().count() == 0
    store.set(["a", "b"], "Slider", "p")
    store.set(["c"], "Sinker", "q")
    store.set(["b"], "", "p")
    assert {(r["PitchUID"], r["tag"]) for r in store.live().collect()} == {("a", "Slider"), ("c", "Sinker")}
    store.clear("p")
    assert {(r["PitchUID"], r["tag"]) for r in store.live().collect()} == {("c", "Sinker")}
    store.set(["a"], "Cutter", "p")
    assert {r["tag"] for r in store.live().collect()} == {"Sinker", "Cutter"}


def test_cluster_runs_names_and_moves(spark, tmp_path):
    rows = pitches(spark, SF).where("PitcherId = '1'")
    name = rows.first()["Pitcher"]
    store = Clusters(spark, str(tmp_path))
    assert store.view(rows, name).columns == rows.columns and store.assignments(name) is None
    store.run(rows, name, starts=1)
    found = store.assignments(name)
    one = found.orderBy("PitchUID").first()
    store.name(name, 0, "Heater")
    store.name(name, 0, "Riser")
    store.move(name, [one["PitchUID"]], 0)
    assert [tuple(r) for r in store.labels(name).collect()] == [(0, "Riser")]
    assert tuple(store.assignments(name).where(F.col("PitchUID") == one["PitchUID"]).first())[1:] == (0, 1.0)
    assert [r["PitchUID"] for r in store.reviewed(name).collect()] == [one["PitchUID"]]
    shown = {r[0] for r in store.view(rows, name).select("TaggedPitchType").distinct().collect()}
    assert "Riser" in shown and shown <= {"Riser", serving.UNCLUSTERED, *(f"Cluster {i}" for i in range(6))}
    store.run(rows, name, starts=1)
    assert store.labels(name).count() == 0 and store.reviewed(name).count() == 0
    tags = Retags(spark, str(tmp_path))
    assert retag_selection(tags, store, name, [one["PitchUID"]], 0) == "cluster" and tags.live().count() == 0
    store.clear(name)
    assert store.current(name) is None
    assert retag_selection(tags, store, name, [one["PitchUID"]], "Slider") == "tag" and tags.live().count() == 1


def test_the_automatic_environment_is_each_balls_own(spark):
    rows = spark.createDataFrame([("D1", "2024-05-01")], "Level string, Date string")
    shown = lambda *picked: tuple(rows.select(*serving.model_key(*picked, None)).first())
    assert shown("Auto", "") == ("D1", "2024") and shown("JUCO", "2023") == ("JUCO", "2023")


def test_scouting_versions(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert scouting.stored_versions(spark, path).count() == 0
    first = scouting.save_version(spark, path, "2026-01-01", player_name="O'Neil, Jr.", role="pitcher", ovr=50, author="AB", author_id=3)
    second = scouting.save_version(spark, path, "2026-01-02", player_name="O'Neil, Jr.", role="pitcher", ovr=60, author="AB", author_id=3)
    held = scouting.stored_versions(spark, path)
    assert (first, second) == (1, 2) and held.count() == 2 and {r["player_key"] for r in held.collect()} == {"name:o-neil-jr"}
    assert [r["ovr"] for r in scouting.latest_threads(held).collect()] == [60]
    assert scouting.delete_thread(spark, path, "name:o-neil-jr", "a3", "2026-01-03")
    assert not scouting.delete_thread(spark, path, "name:nobody", "a3", "2026-01-03")
    assert scouting.latest_threads(scouting.stored_versions(spark, path)).count() == 0


def test_manual_biography(spark, tmp_path):
    path = str(tmp_path / "bio")
    start = spark.createDataFrame([("A", "1", 70, None, "not_found", 1)], "Name string, TrackManId string, HeightIn int, BirthDate string, Status string, seq long")
    start.write.parquet(path)
    bio.save_manual(spark.read.parquet(path), path, "A", "1", 74, "2004-02-29")
    last = bio.latest_bio(spark.read.parquet(path)).collect()
    assert [(r["HeightIn"], r["Status"], r["seq"]) for r in last] == [(74, "manual", 2)]
    shown = {tuple(y): bio.profile(spark.read.parquet(path).where("seq = 2"), y, dt.date(2026, 3, 1)).first() for y in ([2025], [2024, 2025])}
    assert (shown[(2025,)]["age"], shown[(2025,)]["eligible"]) == (21.4, True) and shown[(2024, 2025)]["age"] == 22.0


def test_a_failed_stage_does_not_stop_later_ones():
    ran = []
    out = stages.run_stages([("a", lambda: ran.append("a")), ("b", lambda: 1 / 0), ("c", lambda: ran.append("c"))])
    assert ran == ["a", "c"] and [type(e) for e in out.values()] == [type(None), ZeroDivisionError, type(None)]


def test_schedule(spark, tmp_path):
    made = stages.schedule(spark, *(str(tmp_path / n) for n in ("raw", "tree", "state", "matrix")), dt.date(2024, 6, 1), monthly=True, more=[("bio", lambda: None)])
    assert [n for n, _ in made] == ["serve", "bio", "compact", "matrix"]
    (tmp_path / "raw").mkdir()
    out = stages.run_stages(made)
    assert out["serve"] is None and out["bio"] is None and out["matrix"] is not None


def test_matrix_is_stored_in_order_or_refused(spark, tmp_path):
    p, path = pitches(spark, SF), str(tmp_path / "matrix")
    runs.write_matrix(p, path)
    rows = [(r["Level"], r["year"], r["base_state"], r["Outs"], r["Balls"], r["Strikes"]) for r in spark.read.parquet(path).collect()]
    assert rows == sorted(rows) and rows
    with pytest.raises(ValueError):
        runs.write_matrix(p.limit(0), path)
    assert spark.read.parquet(path).count() == len(rows)


def test_index_is_rebuilt_when_stale(spark, tmp_path):
    p, path = pitches(spark, SF), str(tmp_path / "index")
    teams = spark.createDataFrame([("T1", "C1")], "acronym string, conference string")
    n = serving.load_index(p, "pitcher", path, teams).count()
    spark.range(3).write.mode("overwrite").parquet(path)
    again = serving.load_index(p, "pitcher", path, teams)
    assert again.count() == n and "Conference" in again.columns
    index = serving.picker_index(p, "pitcher", with_files=True)
    name = p.first()["Pitcher"]
    assert serving.rows_of(p, index, "pitcher", name, "", None, []).count() == p.where(F.col("Pitcher") == name).count()


def test_ranks_by_range(spark):
    rows = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0, 9.0, 2.0, 2.0)], "v double")
    assert {tuple(r) for r in runs.average_ranks(rows, "v").collect()} == {(1.0, 1.0), (2.0, 3.0), (5.0, 5.5), (9.0, 7.0)}


def test_swing_values(spark):
    p = pitches(spark, SF)
    matrix = runs.re_matrix(p)
    valued = runs.run_delta(p.where("Level = 'D1'"), runs.re_slice(matrix, "D1", "1995"), game="GameUID").withColumnRenamed("run_delta", "run_value")
    rows = eye.split(eye.decisions(valued.where("run_value IS NOT NULL")))
    counts = runs.count_run_values(matrix.where("Level = 'D1' AND year = '1995'"))
    out = eye.scored_decisions(rows, counts, 2, 2)
    assert out.count() == rows.count() and out.where("ev_swing IS NULL OR score IS NULL").isEmpty()
    assert out.where(F.abs(F.col("score") - (F.col("swung") - F.col("p_swing")) * (F.col("ev_swing") - F.col("ev_take"))) > 1e-9).isEmpty()
    grid = eye.swing_value_grid(spark, eye.swing_value_model(rows, 2, 2), "Left", 1, 1, "Breaking", 9)
    assert grid.count() == 81 and grid.agg(F.min("PlateLocSide"), F.max("PlateLocHeight")).first() == (-2.0, 4.5)


def test_shared_folder(spark, tmp_path):
    assert shared.folder(spark) == spark.conf.get("spark.checkpoint.dir")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string")
    back = shared.written(rows, "some", "k")
    assert back.columns == ["v", "k"] and "PartitionFilters: [isnotnull(k" in back.where("k = 'a'")._jdf.queryExecution().toString()


def test_mirrored_clusters_use_all_candidates(spark):
    found = gmm.fits(pitches(spark, SF).where("PitcherId = '1'"), least=30, starts=1)
    assert found.groupBy("k").count().count() == 6
