"""Order-flow operators without SQL, against row loops."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from marketloom.operators import flow
from marketloom.sources.trades import trades


def test_micro_windows_equal_a_loop(spark, sf_dir):
    hour = 3_600_000
    t = trades(spark, sf_dir)
    sums: dict = defaultdict(lambda: [0] * 6)
    for r in t.collect():
        sums[r.symbol, r.ts_ms - r.ts_ms % (6 * hour)][r.ts_ms % (6 * hour) // hour] += -r.qty if r.is_sell else r.qty
    found = {(r.symbol, r.candle): r for r in flow.micro_window(flow.micro_slots(t, 6 * hour, hour)).collect()}
    assert set(found) == set(sums)
    for k, d in sums.items():
        signs = [1 if x > 0 else -1 for x in d if x]
        flips = sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        assert (found[k].delta, found[k].gross, found[k].flips, found[k].first_half) == (sum(d), sum(map(abs, d)), flips, sum(d[:3]))


def test_large_trades_use_the_limit_of_their_hour(spark):
    rows = [("a", 0, 0, 10, False), ("a", 1, 1, 30, False), ("a", 2, 2, 25, True), ("a", 3_600_000, 3, 25, True), ("a", 3_600_001, 4, 400, True)]
    t = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, qty long, is_sell boolean")
    got = [(r.bucket, r.flow) for r in flow.large_trade_flow(t).orderBy("bucket").collect()]
    mean = 5.0
    for q in (10, 30, 25):
        mean = 0.02 * q + 0.98 * mean
    assert got == [(0, 30 - 25), (3_600_000, -(25 if 25 > 4 * mean else 0) - 400)]


def test_hysteresis_holds_between_the_bounds(spark):
    xs = [0.0, 0.9, 0.5, 0.3, 0.1, 0.5, -0.9, -0.5, 0.5, -0.1, 0.9, -0.5, 0.5]
    b = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "symbol string, bucket long, x double")
    assert [r.state for r in flow.hysteresis(b, "x", 0.8, 0.2).orderBy("bucket").collect()] == [0, 1, 1, 1, 0, 0, -1, -1, 0, 0, 1, 0, 0]


def test_naked_levels_die_once(spark):
    levels = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 50.0)], "symbol string, day long, level double")
    days = spark.createDataFrame([("a", d, h, low) for d, h, low in ((1, 11.0, 9.0), (2, 60.0, 40.0), (3, 10.5, 9.5), (4, 11.0, 9.0))], "symbol string, day long, high double, low double")
    assert {(r.day, r.touched, r.days_naked) for r in flow.naked_levels(levels, days, 0.0).collect()} == {(1, 3, 2), (2, None, 2)}


def test_targets_need_a_margin(spark):
    near, far = flow.structural_targets(F.lit(100.0), F.array(F.lit(100.05), F.lit(101.0), F.lit(105.0)))
    assert spark.range(1).select(near, far).first()[:] == (101.0, 105.0)


def test_sticky_regime_keeps_a_trend_that_is_supported(spark):
    rows = [("chop", 0.0, 0.0), ("trend_up", 0.2, 0.3), ("chop", 0.06, 0.0), ("chop", 0.0, 0.2), ("chop", 0.0, 0.0), ("chop", 0.06, 0.0), ("trend_down", -0.2, 0.0), ("chop", 0.06, -0.2), ("trend_up", 0.2, 0.0), ("expansion", 0.2, 0.2)]
    b = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], "symbol string, bucket long, regime string, slow double, fast double")
    got = [r.sticky for r in flow.sticky_regime(b).orderBy("bucket").collect()]
    assert got == ["chop", "trend_up", "trend_up", "trend_up", "chop", "chop", "trend_down", "trend_down", "trend_up", "expansion"]
