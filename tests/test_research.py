"""Research patterns against loops with queues and last events."""

from __future__ import annotations

import random

import pytest

from marketloom.operators import research

BARS = "symbol string, bucket long, n long, open double, high double, low double, close double, volume double, buy_qty double, sell_qty double, delta double, atr double, ema double, vr double"


def walk(seed, n=500):
    rng, x, out = random.Random(seed), 100.0, []
    for k in range(1, n + 1):
        o, x = x, x + rng.gauss(0, 1)
        high, low = max(o, x) + rng.choice([0, 0.1, 2]), min(o, x) - rng.choice([0, 0.1, 2])
        volume = rng.choice([10.0, 20.0, 90.0])
        buy = volume * rng.random() ** 3 if rng.random() < 0.5 else volume * (1 - rng.random() ** 3)
        out.append(("s", k, k, o, high, low, x, volume, buy, volume - buy, rng.choice([-1.0, 0.0, 1.0, 1.0]), rng.choice([0.5, 1.0, 2.0]), x + rng.uniform(-0.6, 0.6), rng.uniform(1, 2)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(7), BARS)


def test_gaps_above_are_those_of_a_queue(bars):
    got = {r.n: (r.gap_above, r.gap_near) for r in research.gaps_above(bars, 50, 0.02).collect()}
    queue, rows = [], walk(7)
    for i, r in enumerate(rows):
        if i >= 2 and rows[i - 2][5] > r[4]:
            queue.append((rows[i - 2][5], r[4], i))
        queue = [g for g in queue if i - g[2] <= 50 and not g[1] <= r[6] <= g[0]]
        above = [g for g in queue if g[1] > r[6]]
        assert got[i + 1] == (bool(above), any((g[1] - r[6]) / (r[6] + 1e-9) < 0.02 for g in above))
    assert any(a for a, _ in got.values()) and any(a and not b for a, b in got.values()) and any(b for _, b in got.values())


def test_blocks_are_those_of_the_last_event(bars):
    got = {r.n: r.block_near for r in research.block_above(bars, drop=1.0).collect()}
    rows, last, hits = walk(7), None, 0
    for i, r in enumerate(rows):
        if i >= 3:
            o, high, close, atr = (rows[i - 3][c] for c in (3, 4, 6, 11))
            if close > o and close - r[6] > atr and r[6] < o:
                last = (high, o)
        near = False
        if last:
            if r[6] < last[1] * 0.999:
                last = None
            else:
                near = last[1] <= r[6] <= last[0]
        assert got[i + 1] == near
        hits += near
    assert hits >= 3


def test_sides_runs_and_medians(bars):
    out = bars.withColumns({"stacked": research.stacked(), "median": research.upper_median("atr", 6), "regime": research.study_regime()})
    got = {r.n: r for r in research.big_trades(out).collect()}
    rows = walk(7)
    for i, r in enumerate(rows):
        g = got[i + 1]
        part = [x[7] for x in rows[max(0, i - 19) : i + 1]]
        mean, span = sum(part) / len(part), r[4] - r[5] + 1e-9
        assert g.big_sell == (i >= 4 and r[9] > 2.5 * mean and (r[4] - max(r[3], r[6])) / span > 0.30)
        assert g.big_buy == (i >= 4 and r[8] > 2.5 * mean and (min(r[3], r[6]) - r[5]) / span > 0.30)
        last = [x[10] for x in rows[max(0, i - 2) : i + 1]]
        assert g.stacked == ("bullish" if len(last) == 3 and min(last) > 0 else "bearish" if len(last) == 3 and max(last) < 0 else "none")
        held = sorted(x[11] for x in rows[max(0, i - 5) : i + 1])
        assert g.median == held[len(held) // 2]
        three = rows[max(0, i - 2) : i + 1]
        up, down = (all(x[2] > 1 and test(x) for x in three) and len(three) == 3 for test in (lambda x: x[6] > x[12] * 1.002, lambda x: x[6] < x[12] * 0.998))
        atrs = [x[11] for x in rows[max(0, i - 19) : i + 1]]
        wide = i >= 4 and r[11] / (sum(atrs) / len(atrs) + 1e-9) > 1.30
        assert g.regime == ("trend_down" if down else "trend_up" if up else "expansion" if wide else "chop")
    assert {g.regime for g in got.values()} == {"trend_up", "trend_down", "expansion", "chop"} and any(g.big_buy for g in got.values()) and any(g.big_sell for g in got.values())


def test_displaced(bars):
    got = {r.n: r.d for r in bars.select("n", research.displaced().alias("d")).collect()}
    wanted = {r[2]: r[6] < r[3] and (r[3] - r[6]) / (r[4] - r[5] + 1e-9) > 0.65 and r[13] > 1.5 for r in walk(7)}
    assert got == wanted and any(wanted.values())
    assert bars.limit(0).select(research.displaced()).count() == 0
