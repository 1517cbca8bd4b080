"""Limit levels, gaps that turn and the trend test, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import levels as op
from marketloom.operators import rolling_profile

BARS = "symbol string, bucket long, n long, high double, low double, close double, volume long, poc double, atr double, atr_median double, atr_mean double"
R = op.Rules(least=5, area=6, step=1.0, swing=5, block=4, hour=2, gap_bars=8, level_bars=3, rounds=(10.0,), reward=0.1, range_pct=0.0, away=0.1)


def walk(seed, n=160):
    rng, x, out = random.Random(seed), 200.0, []
    for k in range(1, n + 1):
        x += rng.uniform(-3, 3)
        high, low = x + rng.uniform(0, 2), x - rng.uniform(0, 2)
        out.append((f"s{seed}", k * 3_600_000, k, high, low, x, rng.randrange(1, 60), (high + low) / 2, rng.uniform(1, 4), rng.uniform(1, 4), rng.uniform(1, 4)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(1) + walk(2), BARS)


def test_gaps_that_turn_are_those_of_a_loop(bars):
    got = {(r.symbol, r.n): ([tuple(g) for g in r.filled_up], [tuple(g) for g in r.filled_down]) for r in op.inverse_gaps(bars, 8).collect()}
    for seed in (1, 2):
        rows = walk(seed)
        high, low, close = ([r[c] for r in rows] for c in (3, 4, 5))
        for c in range(len(rows)):
            wanted = ([], [])
            for j in range(max(2, c - 7), c - 1):
                for side, (bottom, top) in enumerate([(high[j - 2], low[j]), (high[j], low[j - 2])]):
                    turns = [k for k in range(j + 1, c) if (close[k] < bottom if side == 0 else close[k] > top)]
                    if top > bottom and turns:
                        wanted[side].append((j + 1, bottom, top, turns[0] + 1))
            assert got[f"s{seed}", c + 1] == wanted


def test_trend_of_a_loop(bars):
    got = {(r.symbol, r.n): r.t for r in bars.select("symbol", "n", op.trending(F.col("atr"), F.col("atr_mean"), 3.5, band=0.01).alias("t")).collect()}
    for seed in (1, 2):
        rows = walk(seed)
        for c in range(len(rows)):
            window = [r[5] for r in rows[max(0, c - 59) : c + 1]]
            ema, emas = window[0], []
            for x in window:
                ema = x / 3 + ema * 2 / 3
                emas.append(ema)
            last = list(zip(window, emas, strict=True))[-2:]
            side = all(x > e * 1.01 for x, e in last) or all(x < e * 0.99 for x, e in last)
            assert got[f"s{seed}", c + 1] == (c >= 24 and (rows[c][8] / rows[c][10] > 3.5 or side))


@pytest.mark.parametrize("chunk", [1000, 50, 7])
def test_value_areas_of_a_loop(bars, chunk):
    got = {(r.symbol, r.n): (r.va_poc, r.va_high, r.va_low) for r in rolling_profile.value_areas(bars, 6, 1.0, chunk).collect()}
    assert len(got) == bars.count()
    for seed in (1, 2):
        rows = walk(seed)
        for c in range(len(rows)):
            held = {}
            for r in rows[max(0, c - 5) : c + 1]:
                level = int(r[5] + 0.5)
                held[level] = held.get(level, 0) + r[6]
            chosen, inside = [], 0
            for level, v in sorted(held.items(), key=lambda x: (-x[1], x[0])):
                chosen.append(level)
                inside += v
                if inside >= 0.7 * sum(held.values()):
                    break
            assert got[f"s{seed}", c + 1] == (max(held, key=lambda x: (held[x], x)), max(chosen), min(chosen))


def test_levels_lie_right_and_do_not_crowd(bars):
    found = op.limit_levels(bars, R).collect()
    close = {(r[0], r[1]): r[5] for r in walk(1) + walk(2)}
    assert {r.kind for r in found} >= {"poc_ob", "poc_def", "poc_def_short", "ifvg_bear", "ifvg_bull", "weekly_l", "weekly_h", "round_l", "round_h"}
    seen = set()
    for r in found:
        s = 1 if r.side == "long" else -1
        assert s * (close[r.symbol, r.bucket] - r.price) > 0 and s * (r.price - r.stop) > 0 and s * (r.far - r.price) > 0
        assert abs(r.price - r.stop) >= r.price * 0.0015 * (1 - 1e-12) and abs(r.far - r.price) / abs(r.price - r.stop) >= 0.1
        key = (r.symbol, r.bucket, s, int(r.price / 2 + 0.5))
        assert key not in seen
        seen.add(key)


def test_caps_floors_and_what_is_left_out(spark):
    schema = "symbol string, bucket long, close double, trend boolean, wide boolean, rank int, kind string, s int, price double, stop double, near double, far double"
    rows = [
        ("a", 1, 100.0, False, True, 0, "x", 1, 90.0, 89.99, 91.0, 99.0),  # stop moved to the floor; target capped; near within the cap
        ("a", 1, 100.0, False, True, 1, "y", 1, 90.4, 89.0, None, 99.0),  # within two units of the first
        ("a", 2, 100.0, False, False, 0, "x", 1, 110.0, 109.0, None, 120.0),  # above the price
        ("a", 3, 100.0, True, False, 0, "x", -1, 110.0, 112.0, 109.9, 80.0),  # a trend may take a near target
        ("a", 4, 100.0, False, False, 0, "x", -1, 110.0, 112.0, 109.9, 80.0),  # else it is too near
        ("a", 5, 100.0, True, False, 0, "x", -1, 110.0, 112.0, 95.0, 80.0),  # near beyond the cap
    ]
    got = {(r.bucket, r.kind): (r.stop, r.near, r.far, r.manage) for r in op.ranked(spark.createDataFrame(rows, schema), op.Rules(cap=5.0, reward=1.0, range_pct=0.5)).collect()}
    assert got == {
        (1, "x"): (pytest.approx(90 * 0.9985), None, pytest.approx(90 + 5 * 90 * 0.0015), "fade"),
        (3, "x"): (112.0, 109.9, 100.0, "trail"),
        (5, "x"): (112.0, None, 100.0, "trail"),
    }


def test_gates(bars):
    assert op.limit_levels(bars, op.Rules(least=1000)).isEmpty()
    kinds = {r.kind for r in op.limit_levels(bars, op.Rules(**{**R.__dict__, "experimental": False})).select("kind").distinct().collect()}
    assert kinds and kinds <= {"poc_ob", "poc_def", "poc_def_short"}
    assert {r.volatility for r in op.limit_levels(bars, op.Rules(**{**R.__dict__, "high_only": True})).select("volatility").collect()} == {"high"}
