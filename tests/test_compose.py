"""Whole reports, model storage, exports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from diamondlake.adapter import pitches
from diamondlake.operators import compose, runs, serving

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    held = pitches(spark, SF).persist()
    yield held
    held.unpersist()


def test_reports_hold_every_table(rows):
    name = rows.groupBy("Pitcher").count().orderBy(F.desc("count"), "Pitcher").first()["Pitcher"]
    own = rows.where(F.col("Pitcher") == name)
    report = compose.pitcher_report(own, serving.percentile_pool(rows), hands=["LHH"], counts=["2-strike"])
    assert {k: v.count() for k, v in report.items() if k in ("summary", "hand", "located")} == {"summary": 1, "hand": 1, "located": 1}
    assert all(t.columns for t in report.values()) and report["arsenal"].agg(F.sum("usage")).first()[0] <= 1
    batter = rows.groupBy("Batter").count().orderBy(F.desc("count"), "Batter").first()["Batter"]
    tables = compose.batter_report(rows.where(F.col("Batter") == batter), versus="Left")
    assert tables["families"].where("level = 0").count() <= 1 and tables["summary"].count() == 1


def test_empty_reports(rows):
    assert all(t.count() == 0 for t in compose.pitcher_report(rows.limit(0)).values())
    assert all(t.count() == 0 for t in compose.batter_report(rows.limit(0)).values())


def test_train_store_and_find(spark, rows, tmp_path):
    matrix = runs.re_matrix(rows)
    model = compose.train(rows, matrix, "D1", "1995", str(tmp_path / "models"), k=20)
    assert model.k == 20 and compose.available(spark, str(tmp_path / "models")) == {"D1": ["1995"]}
    with pytest.raises(ValueError):
        compose.training_frame(rows, matrix.unionByName(matrix), "D1", "1995")


def test_export_ends_with_cluster(spark, rows):
    assigned = rows.limit(5).select("PitchUID", F.lit(0).alias("cluster"), F.lit(1.0).alias("conf"))
    names = spark.createDataFrame([(0, None)], "cluster int, name string")
    out = compose.export_rows(rows, assigned, names)
    assert out.columns == [*rows.columns, "ClusterTag"]
    assert {r[0]: r[1] for r in out.groupBy("ClusterTag").count().collect()}["Cluster 0"] == 5
