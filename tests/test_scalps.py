"""Scans in parts, the imbalance maker and votes, against loops and single cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.operators import scalps, scan

DAY = 86_400_000


@pytest.mark.parametrize("part", [DAY, 1_000_000, 7_000])
def test_a_scan_in_parts_is_one_pass(spark, part):
    rng = random.Random(part)
    rows = [(k, t, n, rng.uniform(-1, 1.1), rng.uniform(-5, 5)) for k in "ab" for n, t in enumerate(sorted(rng.randrange(40_000) for _ in range(200)))]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, keep double, add double")
    got = {(r.symbol, r.seq): (r.s, r.e) for r in scan.sample_ema(scan.affine_scan(df, "symbol", ["ts_ms", "seq"], F.col("keep"), F.col("add"), "s", 2.5, part), "symbol", ["ts_ms", "seq"], "add", 0.1, "e", part).collect()}
    for k in "ab":
        state, mean = 2.5, None
        for _, _, n, keep, add in (r for r in rows if r[0] == k):
            state = keep * state + add
            mean = add if mean is None else 0.9 * mean + 0.1 * add
            assert got[k, n] == (pytest.approx(state, rel=1e-9, abs=1e-9), pytest.approx(mean))


def test_decay_by_time(spark):
    df = spark.createDataFrame([("s", 0, 8.0, None), ("s", 100, 0.0, 100.0), ("s", 300, 1.0, 200.0)], "symbol string, ts_ms long, x double, since double")
    got = [r.m for r in scan.decayed_sum(df, "symbol", ["ts_ms"], "x", F.col("since"), 100.0, "m", 150).orderBy("ts_ms").collect()]
    assert got == pytest.approx([8.0, 4.0, 2.0])


def test_no_task_holds_a_symbol(spark):
    df = spark.range(10).select(F.lit("s").alias("symbol"), F.col("id").alias("ts_ms"), F.lit(1.0).alias("x"))
    plan = scan.sample_ema(df, "symbol", ["ts_ms"], "x", 0.1, "e")._jdf.queryExecution().executedPlan().toString()
    # a shuffle by the symbol alone carries sums of parts, never rows
    alone = re.findall(r"hashpartitioning\(symbol#\d+, \d+\)", plan)
    assert len(alone) <= 2 and re.search(r"hashpartitioning\(symbol#\d+, _part#\d+L", plan) and "Window" not in plan


GOOD = {"ts_ms": 10 * 3_600_000, "spread_ticks": 1.0, "vr": 2.0, "fast": 0.90, "slow": 0.60, "cvd": 5.0, "micro": 60_010.0, "close": 60_000.0, "atr": 300.0}


@pytest.mark.parametrize(
    ("change", "side"),
    [
        ({}, "long"),
        ({"fast": 0.10, "slow": 0.40, "cvd": -5.0, "micro": 59_990.0}, "short"),
        ({"fast": 0.10, "slow": 0.40, "cvd": -5.0}, None),
        ({"spread_ticks": 3.0}, None),
        ({"vr": 1.4}, None),
        ({"vr": 5.1}, None),
        ({"slow": 0.54}, None),
        ({"cvd": -1.0}, None),
        ({"micro": 59_999.0}, None),
        ({"ts_ms": 3 * 3_600_000}, None),
        ({"ts_ms": 23 * 3_600_000}, None),
        ({"fast": 0.65}, None),  # London asks for more conviction
        ({"fast": 0.65, "ts_ms": 17 * 3_600_000}, "long"),
    ],
)
def test_the_maker_quotes_where_all_agree(spark, change, side):
    found = scalps.imbalance_maker(spark.createDataFrame([GOOD | change])).collect()
    assert [r.side for r in found] == ([side] if side else [])
    for r in found:
        s = 1 if side == "long" else -1
        target = r.entry * 0.0004 * 1.8
        assert s * (r.near - r.entry) == pytest.approx(target, abs=0.06) and s * (r.far - r.entry) == pytest.approx(1.5 * target, abs=0.06) and s * (r.entry - r.stop) == pytest.approx(0.65 * target, abs=0.06)


def test_votes_ties_and_reasons(spark):
    schema = "close double, value_low double, value_high double, slope double, delta double, taker double, oi_aligned boolean, divergence int, vpin_share double"
    rows = [
        (12.0, 5.0, 10.0, 0.1, 3.0, 0.2, True, 0, None),  # all speak for up
        (4.0, 5.0, 10.0, -0.1, -3.0, -0.2, True, 0, 0.9),
        (7.0, 5.0, 10.0, 0.0, 0.0, 0.0, None, 0, None),
        (7.0, 5.0, 10.0, -0.1, -1.0, None, None, 4, 0.9),
        (7.0, 5.0, 10.0, 0.1, 1.0, None, None, -3, 0.9),
        (None, None, None, None, 1.0, None, None, None, 0.9),  # delta alone: 15, 20 and 25 points
        (None, None, None, 0.1, 1.0, None, None, None, None),
    ]
    got = [(r.state, r.confidence, r.reasons) for r in scalps.auction_state(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got[0] == ("up_imbalance", 100, ["above_value", "cvd_up", "delta_up", "taker_up", "oi_expands"])
    assert got[1][:2] == ("down_imbalance", 100) and got[2] == ("balance", 100, ["in_value", "calm", "cvd_flat", "delta_flat"])
    assert got[3][:2] == ("distribution", 100) and got[4][:2] == ("accumulation", 100)
    assert got[5] == ("unknown", 0, []) and got[6][:2] == ("accumulation", 40)  # up has 35
    tie = scalps.voted([("a", F.lit(True), 30, "x"), ("b", F.lit(True), 30, "y"), ("c", F.lit(None).cast("boolean"), 90, "z")], ["a", "b", "c"], 30)
    assert tuple(spark.range(1).select(*tie).head()) == ("b", 30, ["y"])
