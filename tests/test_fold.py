"""The base-runner fold against a plain walk over sets of bases."""

from __future__ import annotations

import random

import pytest

from diamondlake.operators.fold import annotate, next_state, postseason_start, signatures
from diamondlake.schema import DOMAINS


def as_set(state):
    return {b for b in (1, 2, 3) if state >> b - 1 & 1}


def as_bits(bases):
    return sum(1 << b - 1 for b in bases)


def push(bases, short):
    """Lead runners walk home until ``short`` more runs are in."""
    bases = set(bases)
    while short > 0 and bases:
        bases.remove(max(bases))
        short -= 1
    return bases


@pytest.mark.parametrize(
    ("state", "event", "after"),
    [
        ("000", ("Single", "Undefined", False, 0, 0, False), "100"),
        ("101", ("Single", "Undefined", False, 0, 1, False), "110"),
        ("111", ("Double", "Undefined", False, 0, 2, False), "011"),
        ("111", ("Double", "Undefined", False, 0, 3, False), "010"),
        ("011", ("Triple", "Undefined", False, 0, 2, False), "001"),
        ("111", ("HomeRun", "Undefined", False, 0, 4, False), "000"),
        ("010", ("Error", "Undefined", False, 0, 0, False), "101"),
        ("101", ("Undefined", "Walk", False, 0, 0, False), "111"),
        ("011", ("Undefined", "Undefined", True, 0, 0, False), "111"),
        ("111", ("Undefined", "Walk", False, 0, 1, False), "111"),
        ("101", ("Sacrifice", "Undefined", False, 1, 1, False), "010"),
        ("110", ("Out", "Undefined", False, 2, 0, False), "010"),
        ("111", ("Out", "Undefined", False, 1, 1, False), "110"),
        ("110", ("FieldersChoice", "Undefined", False, 1, 0, False), "110"),
        ("100", ("StolenBase", "Strikeout", False, 0, 0, False), "010"),
        ("101", ("StolenBase", "Undefined", False, 0, 1, False), "100"),
        ("110", ("StolenBase", "Undefined", False, 0, 0, False), "101"),
        ("011", ("CaughtStealing", "Undefined", False, 1, 0, False), "001"),
        ("100", ("Undefined", "Undefined", False, 1, 0, True), "000"),
        ("100", ("Undefined", "Undefined", False, 0, 0, True), "010"),
        ("000", ("Undefined", "Undefined", False, 0, 1, True), "000"),
        ("011", ("Undefined", "Undefined", False, 0, 1, False), "010"),
        ("111", ("Undefined", "Strikeout", False, 0, 0, False), "111"),
    ],
)
def test_events(state, event, after):
    bits = sum(1 << i for i in range(3) if state[i] == "1")
    out = next_state(bits, *event)
    assert "".join(str(out >> i & 1) for i in range(3)) == after


def test_hits_by_sets():
    for state in range(8):
        for name, n in (("Single", 1), ("Double", 2), ("Triple", 3), ("HomeRun", 4)):
            for runs in range(5):
                moved = {b + n for b in as_set(state)}
                scored = sum(b > 3 for b in moved) + (n == 4)
                bases = {b for b in moved if b < 4} | ({n} if n < 4 else set())
                assert next_state(state, name, "Undefined", False, 0, runs, False) == as_bits(push(bases, runs - scored))


def test_signatures_are_total(spark):
    table = signatures(spark)
    assert table.count() == 11 * 3 * 2 * 4 * 5 * 2
    assert table.where("size(moves) <> 8 OR exists(moves, m -> m < 0 OR m > 7)").isEmpty()


def test_annotate_equals_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    for game in range(6):
        name, level = f"2024{rng.choice(['0401', '0615'])}-{game}.csv", rng.choice(["D1", "JUCO"])
        for inning in (1, 10):
            ghost = inning >= 10 and not (level == "D1" and name.startswith("20240615"))
            state = 2 if ghost else 0
            for i in range(12):
                result, walk = rng.choice(DOMAINS["PlayResult"]), rng.choice(DOMAINS["KorBB"])
                call, outs, runs = rng.choice(["HitByPitch", "InPlay", None]), rng.randint(0, 3), rng.randint(0, 4)
                uid = f"{game}-{inning}-{i}"
                rows.append((name, f"G{game}", uid, level, inning, "Top", i, 1, i, 0, 1, 2, call, walk, result, outs, runs, None))
                want[uid] = "".join(str(state >> b & 1) for b in range(3))
                state = next_state(state, result, walk, call == "HitByPitch", outs, runs, False)
    rng.shuffle(rows)
    schema = (
        "file_name string, GameUID string, PitchUID string, Level string, Inning long, `Top/Bottom` string, PAofInning long, PitchofPA long, PitchNo long, "
        "Outs long, Balls long, Strikes long, PitchCall string, KorBB string, PlayResult string, OutsOnPlay long, RunsScored long, ThrowSpeed double"
    )
    out = annotate(spark.createDataFrame(rows, schema)).collect()
    assert {r["PitchUID"]: r["base_state"] for r in out} == want
    assert all(r["re288_state"] == f"{r['base_state']}|0|1-2" for r in out)


def test_postseason(spark):
    from pyspark.sql import functions as F

    days = spark.createDataFrame([(2024,), (2025,), (2026,)], "y int").select(postseason_start(F.col("y")).cast("string"))
    assert [r[0] for r in days.collect()] == ["2024-05-31", "2025-05-30", "2026-05-29"]
