"""Operators on hand-made rows and against row loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.functions import clocks, scalars, units
from marketloom.operators import bars, depth, detectors, indicators, joins, mining, profile, recursive, reports, simulate, structure
from marketloom.sources import sinks, trades as src

TRADE = "symbol string, ts_ms long, seq long, price double, price_units long, qty long, is_sell boolean"
BAR = "symbol string, bucket long, open double, high double, low double, close double, buy_qty long, sell_qty long, volume long, delta long"


def trade_rows(spark, rows):
    return spark.createDataFrame([("a", t, i, p, round(p * 10**8), q, s) for i, (t, p, q, s) in enumerate(rows)], TRADE)


def bar_rows(spark, ohlc):
    return spark.createDataFrame([("a", i * 1000, *map(float, x), 6, 4, 10, 2) for i, x in enumerate(ohlc)], BAR)


def test_steps_round_down_for_negatives(spark):
    d = spark.createDataFrame([(-7,), (-5,), (0,), (5,), (7,), (15,)], "u long")
    got = d.select(units.floor_to_step("u" and F.col("u"), 10), units.ceil_to_step(F.col("u"), 10), units.round_to_step(F.col("u"), 10)).collect()
    assert [tuple(r) for r in got] == [(-10, 0, -10), (-10, 0, 0), (0, 0, 0), (0, 10, 10), (0, 10, 10), (10, 20, 20)]


def test_clocks_overlap(spark):
    d = spark.createDataFrame([(h * clocks.HOUR,) for h in (0, 8, 13, 16, 22)], "t long")
    got = d.select(clocks.region(F.col("t")), clocks.in_session(F.col("t"), "london"), clocks.in_session(F.col("t"), "new_york")).collect()
    assert [tuple(r) for r in got] == [("asia", False, False), ("london", True, False), ("overlap", True, True), ("new_york", False, True), ("off_hours", False, False)]
    assert d.select(clocks.weekday(F.lit(0))).first()[0] == 3  # a Thursday


def test_gates_and_formats(spark):
    d = spark.range(1)
    none = F.lit(None).cast("double")
    assert d.select(scalars.funding_long_ok(none), scalars.funding_short_ok(F.lit(-0.001)), scalars.ramp(F.lit(15.0), 10, 20), scalars.price_relation(F.lit(1.0), none)).first()[:] == (True, False, 0.5, "unknown")
    assert d.select(scalars.abbreviated(F.lit(12_345.0)), scalars.duration_text(F.lit(93_784_000)), scalars.first_reason((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"))).first()[:] == ("12.35k", "1d 2h", "b")


def test_bars_take_first_and_last_by_time_and_sequence(spark):
    t = trade_rows(spark, [(5, 2.0, 1, False), (5, 3.0, 2, True), (1, 9.0, 4, False), (70_000, 1.0, 1, True)])
    got = {r.bucket: r for r in bars.time_bars(t, 60_000).collect()}
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].delta, got[0].n_trades) == (9.0, 9.0, 2.0, 3.0, 3, 3)
    assert got[60_000].sell_qty == 1
    assert [r.bucket for r in bars.missing_buckets(bars.time_bars(t, 10_000), 10_000).orderBy("bucket").collect()] == [10_000 * k for k in range(1, 7)]
    assert bars.time_bars(t.limit(0), 60_000).count() == 0


def test_tick_bars_cross_days(spark):
    rows = [(i * 40_000_000, float(i), 1, False) for i in range(10)]
    got = bars.tick_bars(trade_rows(spark, rows), 4).orderBy("bar").collect()
    assert [(r.open, r.close, r.n_trades) for r in got] == [(0.0, 3.0, 4), (4.0, 7.0, 4), (8.0, 9.0, 2)]


def test_poc_tie_and_status(spark):
    t = trade_rows(spark, [(0, 1.0, 5, False), (1, 2.0, 5, True), (60_000, 4.0, 1, True), (120_000, 1.2, 1, True), (130_000, 0.8, 1, True)])
    step = 10**8
    poc = bars.points_of_control(bars.footprint(t, 60_000, step))
    got = {r.bucket: (r.poc, r.status, r.filled_at) for r in bars.poc_status(poc, bars.time_bars(t, 60_000), step).collect()}
    assert got == {0: (step, "filled", 120_000), 60_000: (4 * step, "naked", None), 120_000: (step, "none", None)}


def test_as_of_carries_over_days_and_ties_see_the_same_time(spark):
    day = 86_400_000
    left = spark.createDataFrame([("k", t) for t in (5, 10, day + 1, 3 * day)] + [("z", 1)], "k string, t long")
    right = spark.createDataFrame([("k", 10, 1.0), ("k", 20, 2.0), ("k", day * 2, None)], "k string, t long, v double")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", ["v"]).collect()}
    assert got == {("k", 5): None, ("k", 10): 1.0, ("k", day + 1): 2.0, ("k", 3 * day): None, ("z", 1): None}


def test_as_of_takes_the_last_of_equal_times(spark):
    day = 86_400_000
    left = spark.createDataFrame([("k", t) for t in (10, day + 1)], "k string, t long")
    for right in ([(9, 1.0, 7), (9, 2.0, 5)], [(9, 2.0, 5), (9, 1.0, 7)]):
        right = spark.createDataFrame([("k", *r) for r in right], "k string, t long, v double, seq long").coalesce(1)
        assert {r.v for r in joins.as_of(left, right, "k", "t", ["v"], tie=["seq"]).collect()} == {1.0}
        assert {r.v for r in joins.as_of(left, right, "k", "t", ["v"]).collect()} == {2.0}


def test_trailing_sums_are_those_of_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(4_000) // 3 * 3, k, rng.random() < 0.5, rng.choice([None, *[q / 4 for q in range(60)]])) for k in range(400)]
    found = indicators.trailing_sums(spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, is_sell boolean, usd double"), 300, 90, 40.0, 0.6)
    for r in found.collect():
        near = lambda ms: [x for x in rows if x[0] == r.symbol and r.ts_ms - ms <= x[1] <= r.ts_ms and x[4] is not None]  # noqa: E731, B023
        short = [x[4] for x in near(90)]
        assert (r.sells, r.buys) == tuple(sum(x[4] for x in near(300) if x[3] == s) for s in (True, False))
        assert r.cascade == (sum(short) > 40 if short else None)
    assert found.count() == len(rows) and "RangeFrame" not in found._jdf.queryExecution().toString()


def test_windows_and_joins_that_grow_with_the_input_only(spark):
    levels = spark.createDataFrame([("a", k, 5) for k in range(4)], "symbol string, at long, level long")
    ranges = spark.createDataFrame([("a", 1, 5, 5), ("a", 3, 0, 5)], "symbol string, at long, lo long, hi long")
    found = bars.first_touch(levels, ranges, 5)
    assert {r.at: r.touched for r in found.collect()} == {0: 1, 1: 3, 2: 3, 3: None}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    rows = spark.createDataFrame([("a", k, ["x"], float(k)) for k in range(9)], "s string, o long, holds array<string>, r double")
    plan = mining.permutation_null(rows, ["s"], "o", 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [s#" in plan


def test_first_hit_prefers_the_stop(spark):
    s = spark.createDataFrame([("a", 0, 10.0, 9.0, 12.0)], "symbol string, n int, entry double, stop double, target double")
    b = spark.createDataFrame([("a", 1, 11.0, 9.5, 10.5), ("a", 2, 12.5, 8.5, 10.0)], "symbol string, n int, high double, low double, close double")
    assert joins.first_hit(s, b, 5).select("outcome", "hit_n", "r").first()[:] == ("stop", 2, -1.0)
    assert joins.first_hit(s, b, 1).select("outcome", "r").first()[:] == ("timeout", 0.5)


def test_recursions_equal_loops(spark):
    random.seed(1)
    close = [10 + random.random() for _ in range(40)]
    b = bar_rows(spark, [(c, c + 0.5, c - 0.3, c) for c in close])
    got = [r.e for r in recursive.ema(b, "close", 9, "e").orderBy("bucket").collect()]
    s = close[0]
    for x, g in zip(close, got, strict=True):
        s = x if x is close[0] else 0.2 * x + 0.8 * s
        assert math.isclose(s, g)
    adx = recursive.adx(b).orderBy("bucket").collect()
    assert adx[13].adx is None and 0 <= adx[30].adx <= 100


def test_pivots_are_known_late_and_breaks_change_character(spark):
    prices = [1, 2, 5, 2, 1, 2, 3, 6, 5, 4, 2, 0.5]
    b = bar_rows(spark, [(p, p + 0.1, p - 0.1, p) for p in prices])
    got = structure.breaks(structure.confirmed_swings(b, 2, 2)).orderBy("bucket").collect()
    assert got[2].swing_high == pytest.approx(5.1) and got[2].known_at == 4000 and got[3].last_swing_high is None
    assert got[7].structure == "break" and got[11].structure == "change"


def test_gaps_and_blocks(spark):
    b = bar_rows(spark, [(1, 2, 0.9, 1.9), (2, 4, 1.9, 3.9), (4, 6, 3.0, 5.9), (6, 8, 5.5, 7.9)])
    got = structure.fair_value_gaps(b).collect()
    assert {(r.side, r.bottom, r.top) for r in got} == {("up", 2.0, 3.0), ("up", 4.0, 5.5)}
    b = bar_rows(spark, [(5, 5.1, 4, 4.2), (4.2, 5, 4.1, 4.9), (4.9, 6, 4.8, 5.9), (6, 6.2, 3, 3.5)])
    blocks = structure.order_blocks(b)
    assert [(r.side, r.bucket, r.known_at) for r in blocks.collect()] == [("up", 0, 2000)]
    assert structure.block_states(blocks, b).first().state == "invalidated"


def test_cooldown_is_greedy(spark):
    d = spark.createDataFrame([("a", t) for t in (0, 3, 5, 9, 10, 16)], "k string, t long")
    assert sorted(r.t for r in structure.cooldown(d, "k", "t", 5).collect()) == [0, 5, 10, 16]


def area_loop(levels, total, ties_up=True):
    keys = sorted(levels)
    at = keys.index(max(keys, key=lambda k: (levels[k], -k)))
    lo = hi = at
    held = levels[keys[at]]
    while held < 0.7 * total and (lo > 0 or hi < len(keys) - 1):
        up = levels[keys[hi + 1]] if hi < len(keys) - 1 else -1
        down = levels[keys[lo - 1]] if lo else -1
        if up >= down if ties_up else up > down:
            hi, held = hi + 1, held + up
        else:
            lo, held = lo - 1, held + down
    return keys[lo], keys[hi], held


def test_contiguous_value_area_equals_a_loop(spark):
    random.seed(5)
    rows = {d: {k * 10: random.randint(0, 9) for k in random.sample(range(30), random.randint(1, 20))} for d in range(20)}
    p = spark.createDataFrame([("a", d, k, q) for d, ls in rows.items() for k, q in ls.items()], "symbol string, day long, level long, qty long")
    for up in (True, False):
        for r in profile.contiguous_area(p, ties_up=up).collect():
            assert (r.value_low, r.value_high, r.inside) == area_loop(rows[r.day], sum(rows[r.day].values()), up)


def test_paper_account_order_of_exits(spark):
    H = clocks.HOUR
    rows = [(0, 10.2, 9.9, 10.0), (H, 12.5, 8.9, 10.0), (2 * H, 10.5, 9.8, 10.0), (3 * H, 12.5, 10.0, 12.2)]
    b = spark.createDataFrame([("a", *r) for r in rows], "symbol string, bucket long, high double, low double, close double")
    s = spark.createDataFrame([("a", 0, "long", 10.0, 9.0, 12.0), ("a", 2 * H, "long", 10.0, 9.0, 12.0)], "symbol string, bucket long, side string, entry double, stop double, target double")
    got = simulate.paper_account(b, s, simulate.Rules(fee_bps=0, slippage_bps=0)).orderBy("opened").collect()
    assert [(r.reason, round(r.r, 6)) for r in got] == [("stop", -1.0), ("target", 2.0)]
    assert got[1].balance == pytest.approx(10_000 * 0.99 * 1.02)
    got = simulate.paper_account(b, s, simulate.Rules(partial_at_r=1.0)).count()
    assert got == 2


def test_kill_switch_stays(spark):
    a = simulate.Account("a", simulate.Rules(max_drawdown=0.005, fee_bps=0, slippage_bps=0))
    sig = {"side": "long", "entry": 10.0, "stop": 9.0, "target": 12.0}
    for k in range(6):
        a.step({"bucket": k * clocks.DAY, "high": 10, "low": 8.0, "close": 9.5}, sig)
    assert len(a.closed) == 1 and a.halted


def test_book_replay_and_features(spark):
    level = "array<struct<price:double,qty:double>>"
    rows = [
        ("a", 1, 0, "snapshot", [(10.0, 5.0), (9.0, 1.0)], [(11.0, 2.0)]),
        ("a", 2, 1, "delta", [(10.0, 0.0)], [(10.5, 3.0)]),
        ("a", 1, 2, "delta", [(10.4, 9.0)], []),
        ("a", 3, 3, "delta", [(11.0, 9.0)], []),
    ]
    m = spark.createDataFrame(rows, f"symbol string, ts_ms long, seq long, type string, b {level}, a {level}")
    got = depth.book_features(depth.book_samples(m)).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.mid) for r in got] == [(1, 10.5), (1, pytest.approx(10.7)), (2, 9.75)] or [(r.ts_ms, r.mid) for r in got][0] == (1, 10.5)
    assert depth.book_bars(depth.book_features(depth.book_samples(m))).first().n_samples == len(got)


def test_books_are_unknown_before_a_snapshot(spark):
    level = "array<struct<price:double,qty:double>>"
    rows = [("a", 1, 0, "delta", [(10.0, 5.0)], [(11.0, 2.0)]), ("a", 2, 1, "snapshot", [(9.0, 5.0)], [(12.0, 2.0)]), ("a", 3, 2, "delta", [(10.0, 1.0)], [])]
    got = depth.book_features(depth.book_samples(spark.createDataFrame(rows, f"symbol string, ts_ms long, seq long, type string, b {level}, a {level}"))).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.mid) for r in got] == [(2, 10.5), (3, 11.0)]


def runs_by_loop(samples, every):
    """Book samples (time, {(level, side): qty}) one after the other, as the rule is stated."""
    runs, before = defaultdict(list), None
    for ts, book in samples:
        gap = before is not None and ts > before + every
        for (level, bid), qty in sorted(book.items(), key=lambda x: not x[0][1]):
            own = runs[level]
            last = own[-1] if own else None
            if last and last[3] == bid and ts > last[1] and gap:
                if last[2] == qty:
                    last[1] = ts + every
                    continue
                last[1] = ts
            elif last and last[3] == bid and ts <= last[1] and last[2] == qty:
                last[1] = max(last[1], ts + every)
                continue
            elif last and last[1] > ts:
                last[1] = ts
            own.append([ts, ts + every, qty, bid])
        before = ts
    return sorted((level, *r) for level, own in runs.items() for r in own if r[1] > r[0])


@pytest.mark.parametrize("seed", range(3))
def test_depth_runs_equal_the_loop(spark, seed):
    rng, ts, samples = random.Random(seed), 0, []
    for _ in range(60):
        ts += rng.choice((5, 10, 10, 10, 25, 60))
        samples.append((ts, {(rng.randint(1, 3), rng.random() < 0.6): rng.randint(1, 3) for _ in range(rng.randint(1, 3))}))
    rows = [("a", ts, level, qty, bid) for ts, book in samples for (level, bid), qty in book.items()]
    got = depth.depth_runs(spark.createDataFrame(rows, "symbol string, ts_ms long, level long, qty long, is_bid boolean"), 10).collect()
    assert sorted((r.level, r.start, r.until, r.qty, r.is_bid) for r in got) == runs_by_loop(samples, 10)


def test_touching_runs_coalesce(spark):
    rows = [("a", 7, True, 0, 20, 5), ("a", 7, True, 20, 30, 3), ("a", 7, True, 100, 110, 3)]
    merged = depth.coalesce_runs(spark.createDataFrame(rows, depth.RUNS), 0.5).collect()
    assert sorted((r.start, r.until, r.qty) for r in merged) == [(0, 30, 4), (100, 110, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 400), i) for i, k in enumerate(rng.choices("ab", k=150))]
    wanted = []
    for k in "ab":
        free = None
        for _, x, i in sorted(r for r in rows if r[0] == k):
            if free is None or x >= free:
                wanted.append((k, x))
                free = x + 37
    got = structure.cooldown(spark.createDataFrame(rows, "k string, x long, i long"), "k", "x", 37, part=50).collect()
    assert sorted((r.k, r.x) for r in got) == sorted(wanted)


def test_block_states_see_all_later_bars(spark):
    bars = [(k, *x) for k, x in enumerate([(9, 11, 10), (9, 11, 10), (9, 11, 10), (12, 14, 13), (11, 13, 12), (8, 12, 9)])]
    b = spark.createDataFrame([("a", k, float(h), float(lo), float(c)) for k, lo, h, c in bars], "symbol string, bucket long, high double, low double, close double")
    blocks = spark.createDataFrame([("a", "up", 0, 3, 11.5, 10.5), ("a", "up", 1, 2, 9.0, 6.5), ("a", "down", 2, 4, 12.5, 11.5), ("a", "up", 5, 5, 1.0, 0.5)], "symbol string, side string, bucket long, known_at long, high double, low double")
    assert {(r.bucket, r.state) for r in structure.block_states(blocks, b).collect()} == {(0, "invalidated"), (1, "tested"), (2, "mitigated"), (5, "active")}


def test_router_takes_the_best_and_gates_rewards(spark):
    row = dict(symbol="a", bucket=1, close=10.0, high=10.5, low=9.5, atr=1.0, delta=-5, swept_low=True, swept_high=False, prev_close=9.0, value_high=12.0, value_low=8.0, poc=11.0, region="asia", cvd_slope=1.0, taker=0.2, regime="chop", vwap=9.0, upper2=12.0, lower2=8.0, divergence=0, volume_ratio=1.0, prev_high20=12.0, prev_low20=8.0)
    d = spark.createDataFrame([row])
    got = detectors.route(d).collect()
    assert [(r.detector, r.side) for r in got] == [("range_reversal", "long")]
    assert detectors.route(d, least_reward=5.0).count() == 0
    near = detectors.near_misses(d, {"big": F.col("volume_ratio") > 2, "sell": F.col("delta") < 0})
    assert near.first().failed == ["big"]


def test_run_length_signs(spark):
    b = bar_rows(spark, [(1, 1, 1, 1)] * 6).withColumn("x", F.element_at(F.array(*[F.lit(v) for v in (1, 1, 0, -1, -1, 1)]), (F.col("bucket") / 1000 + 1).cast("int")))
    assert [r.n for r in indicators.run_length(b, F.col("x"), "n").orderBy("bucket").collect()] == [1, 2, 0, -1, -2, 1]


def test_bootstrap_holds_the_mean(spark):
    random.seed(2)
    rows = [("a", i, random.gauss(0.3, 1)) for i in range(500)]
    got = mining.bootstrap_mean(spark.createDataFrame(rows, "k string, seq long, r double"), "k", 200).first()
    assert got.low < sum(r for *_, r in rows) / 500 < got.high


def test_models_learn_a_threshold(spark):
    d = spark.createDataFrame([(float(i % 10), float(i % 3), 1.0 if i % 10 > 5 else 0.0) for i in range(300)], "x double, z double, y double")
    assert mining.fill_model(d, ["x", "z"], "y").coefficients[0] > 0
    assert mining.importance(d, ["x", "z"], "y")["x"] > 0.8


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,symbol,side,size,price,tickDirection\n1.5,x,Buy,2,10.5,up\n2.5,x,Sell,1,0,up\nbad\n")
    t = src.read_trades_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.ts_ms, r.price, r.is_sell) for r in t] == [(1500, 10.5, False)]
    assert sorted(r.price for r in src.read_trades_csv(spark, str(tmp_path / "t.csv"), positive=False).collect()) == [0.0, 10.5]
    (tmp_path / "b.json").write_text('{"type":"snapshot","ts":5,"data":{"s":"x","b":[["1","2"]],"a":[["3","4"]]}}\nnoise\n')
    assert src.read_book_json(spark, str(tmp_path / "b.json")).first().b[0].qty == 2.0
    lines = spark.createDataFrame([('{"e":"forceOrder","o":{"s":"x","S":"SELL","q":"2","ap":"0","p":"10","T":7}}',), ("{}",)], "value string")
    assert src.parse_force_orders(lines).first()[:] == ("x", 7, "long", 10.0, 2.0, 20.0)
    b = bars.time_bars(trade_rows(spark, [(0, 1.0, 1, False), (clocks.DAY, 2.0, 1, True)]), clocks.HOUR)
    sinks.write_bars(b, str(tmp_path / "bars"))
    assert src.read_bars(spark, str(tmp_path / "bars"), ["symbol", "close"]).count() == 2
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, version int")
    assert {(r.id, r.v) for r in sinks.latest(rows, ["id"], ["version"]).collect()} == {(1, "b"), (2, "c")}
    sinks.write_log(rows, str(tmp_path / "log"))
    assert src.read_json_lines(spark, str(tmp_path / "log"), "id int, v string").count() == 3


def test_reports_divide_by_nothing(spark):
    o = spark.createDataFrame([("a", "fill")], "k string, event string")
    assert reports.fill_ratio(o, "k").first().fill_ratio is None


def test_band_pairs_are_dealt_by_slots(spark):
    """A side that looked small was broadcast, and the tasks were the files of the other side, however many pairs each made."""
    rng = random.Random(4)
    a, b = ([(1, rng.randrange(3000), k) for k in range(120)] for _ in "ab")
    found = joins.band(spark.createDataFrame(a, "k int, ta long, a long"), spark.createDataFrame(b, "k int, tb long, b long"), "k", "ta", "tb", 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((x, y) for _, s, x in a for _, t, y in b if abs(s - t) <= 100)
