"""Every domain query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from diamondlake.adapter import TABLES
from diamondlake.plans.oracles import ORACLES
from diamondlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    asked = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    want = sorted((tuple(map(plain, row)) for row in asked.fetchall()), key=str)
    have = sorted((tuple(map(plain, row)) for row in got.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert have == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
