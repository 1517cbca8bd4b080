"""Microstructure events and exhausted buyers, against loops over the bars."""

from __future__ import annotations

import numpy as np
import pytest

from marketloom.operators import exhaustion, microevents

DAY = 86_400_000
START = 1_704_067_200_000
R = microevents.Rules(base=100, least=10, burst=4, extreme=12, rest=6, after=(1, 3, 7))


def panel(seed, days=2, n=400):
    """Quiet seconds with shocks of all kinds."""
    rng = np.random.default_rng(seed)
    out = []
    for d in range(days):
        mid = 1000 + np.cumsum(rng.choice([0, 0, 0.05, -0.05, 2, -2], n, p=[0.4, 0.3, 0.11, 0.11, 0.04, 0.04]))
        loud = np.repeat(rng.random(n // 4) < 0.025, 4)
        vol = (rng.integers(0, 20, n) + 400 * loud).astype(int)
        delta = (vol * rng.choice([-1, -0.2, 0.2, 1], n)).astype(int)
        spread = 1 + rng.random(n) * 0.1 + 30 * (rng.random(n) < 0.02)
        obi = rng.choice([-0.9, -0.6, 0, 0.6, 0.9], n)
        micro = mid * (1 + spread * 1e-4 * rng.choice([-0.4, 0, 0.4], n))
        for k in range(n):
            at = START + d * DAY + k * 1000
            out.append((f"s{seed}", at, at + 7, float(mid[k]), float(micro[k]), float(obi[k]), float(spread[k]), int(vol[k]), int(delta[k]), int(vol[k] // 2)))
    return out


PANEL = "symbol string, second long, ts_ms long, mid double, micro double, obi10 double, spread_bps double, vol long, delta long, max_trade long"


def events_of_a_day(rows):
    """Each kind by a loop over the seconds of a day."""
    n = len(rows)
    mid, micro, obi, spread, vol, delta, most = (np.array([r[c] for r in rows], float) for c in range(3, 10))

    def stats(x, i):
        w = x[max(0, i - R.base + 1) : i + 1]
        return (w.mean(), w.std(ddof=1)) if len(w) >= R.least else (np.nan, np.nan)

    out = []
    last = {}
    for i in range(n):
        if i + R.after[2] >= n:
            continue
        w = slice(max(0, i - R.burst + 1), i + 1)
        d, v = delta[w].sum(), vol[w].sum()
        (vm, vs), (_, ds), (bm, bs), (sm, ss) = (stats(x, i) for x in (vol, delta, most, spread))
        big, spike = most[i] >= bm + 3 * (bs + 1e-9), v >= R.burst * (vm + 3 * (vs + 1e-9))
        move = abs((mid[i] - mid[i - R.burst]) / mid[i]) if i >= R.burst else np.nan
        heavy = v >= R.burst * (vm + vs + 1e-9) and move < 0.0002
        before = mid[max(0, i - R.extreme) : i]
        old = obi[i - R.burst] if i >= R.burst else np.nan
        lean = (micro[i] - mid[i]) * 1e4 / (spread[i] * mid[i] + 1e-9)
        burst = 3 * (ds * np.sqrt(R.burst) + 1e-9)
        hit = {
            "big_trade_buy": big and delta[i] > 0, "big_trade_sell": big and delta[i] < 0, "delta_burst_pos": d >= burst, "delta_burst_neg": d <= -burst, "vol_spike": spike, "absorb_ask": heavy and d > 0, "absorb_bid": heavy and d < 0,
            "sweep_up": len(before) and mid[i] > before.max() and spike, "sweep_down": len(before) and mid[i] < before.min() and spike, "obi_extreme_pos": obi[i] >= 0.8, "obi_extreme_neg": obi[i] <= -0.8,
            "obi_flip_up": old < -0.5 and obi[i] > 0.5, "obi_flip_down": old > 0.5 and obi[i] < -0.5, "spread_spike": spread[i] >= sm + 5 * (ss + 1e-9), "micro_div_up": lean > 0.25, "micro_div_down": lean < -0.25,
        }
        for kind, yes in hit.items():
            if yes and i - last.get(kind, -R.rest) >= R.rest:
                last[kind] = i
                later = mid[i : i + R.after[2]]
                back = [(x / mid[i] - 1) * 1e4 for x in (*(mid[i + h] for h in R.after), later.max(), later.min())]
                out.append((rows[i][0], rows[i][2], kind, microevents.KINDS[kind], *back))
    return out


def test_events_are_those_of_a_loop(spark):
    rows = panel(1) + panel(6)
    wanted = sorted(e for s in (1, 6) for d in range(2) for e in events_of_a_day([r for r in rows if r[0] == f"s{s}" and (r[1] - START) // DAY == d]))
    found = microevents.micro_events(spark.createDataFrame(rows, PANEL), R).select("symbol", "ts_ms", "event", "hint", "after_1", "after_2", "after_3", "best", "worst")
    got = sorted(map(tuple, found.collect()))
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in wanted], atol=1e-6)
    assert {g[2] for g in got} == set(microevents.KINDS)


def test_one_event_of_an_island(spark):
    rows = [("s", t, e) for t, e in [(0, "vol_spike"), (50, "sweep_up"), (90, "micro_div_up"), (200, "obi_flip_up"), (200, "big_trade_buy"), (DAY + 10, "vol_spike")]]
    found = microevents.resolved(spark.createDataFrame(rows, "symbol string, ts_ms long, event string"), 60)
    assert sorted((r.ts_ms, r.event, r.of_island) for r in found.collect()) == [(50, "sweep_up", 3), (200, "big_trade_buy", 2), (DAY + 10, "vol_spike", 1)]


X = exhaustion.Rules(windows=(4, 7), narrow=0.02, wide=2.0, turn_bars=2, turn_ratio=0.3, volume=1.1, volume_bars=12, rest=9, sessions=("asia", "london", "overlap"))
BARS = "symbol string, bucket long, n long, open double, high double, low double, close double, volume double, delta double, spread_bps double, absorbed_ask boolean, oi_change double"


def bars(seed, n=1500):
    rng = np.random.default_rng(seed)
    out, x = [], 100.0
    for k in range(1, n + 1):
        o, x = x, x + rng.normal(0, 0.05) - 0.3 * (rng.random() < 0.06) + 0.018
        high, low = max(o, x) + rng.random() * 0.03, min(o, x) - rng.random() * 0.03
        out.append((f"s{seed}", START + k * 900_000, k, o, high, low, x, float(rng.integers(50, 150)) * (3 if x < o - 0.2 else 1), float(rng.integers(-40, 60)) if x > o - 0.2 else -50.0, float(rng.integers(0, 7)), bool(rng.random() < 0.5), float(rng.normal()) if rng.random() < 0.7 else None))
    return out


def tired(rows):
    """Signals by one pass with the bars seen so far."""
    out, last = [], 0
    for i, (_, bucket, n, o, high, low, close, volume, delta, spread, absorbed, oi) in enumerate(rows):
        minute = bucket // 60_000 % 1440
        base = [r[7] for r in rows[max(0, i - 16) : i + 1]]
        vr, span = volume / (sum(base) / len(base)), high - low
        if n < 12 + 7 or (last and n - last < 9) or not minute < 960 or vr < 1.1 or delta >= 0 or spread > 5:
            continue
        if span > 1e-10 and ((close - low) / span > 0.35 or max(o - close, 0) / span < 0.35 or (high - max(o, close)) / span > 0.30):
            continue
        for win in (4, 7):
            before = rows[i - win : i]
            top, bottom, flow, turn = max(r[4] for r in before), min(r[5] for r in before), sum(r[8] for r in before), sum(r[8] for r in before[-2:])
            if not 0.02 <= (top - bottom) / close * 100 <= 2.0 or flow <= 0 or turn >= 0 or -turn / flow < 0.3 or close >= bottom or (bottom - close) / (top - bottom) > 0.5:
                continue
            stop = max(top, high)
            if low <= close - 2 * (stop - close):
                continue
            signs = ["absorbed_ask"] * absorbed + ["oi_change"] * (oi is not None and oi < 0)
            out.append((n, win, stop, ",".join(signs), len(signs)))
            last = n
            break
    return out


def test_tired_buyers_are_those_of_a_loop(spark):
    rows = bars(1) + bars(2)
    found = exhaustion.buyer_exhaustion(spark.createDataFrame(rows, BARS), X).collect()
    total = 0
    for s in ("s1", "s2"):
        wanted = tired([r for r in rows if r[0] == s])
        got = sorted((r.n, r.range_bars, r.stop, r.signs, r.score) for r in found if r.symbol == s)
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in wanted] and [g[2] for g in got] == pytest.approx([w[2] for w in wanted])
        total += len(got)
    assert total > 2


def test_sessions_and_gates(spark):
    df = spark.createDataFrame(bars(1), BARS)
    late = exhaustion.buyer_exhaustion(df, exhaustion.Rules(**{**X.__dict__, "sessions": ("off_hours",)})).collect()
    assert late and all(r.bucket // 60_000 % 1440 >= 1260 for r in late)
    plain = exhaustion.buyer_exhaustion(df.drop("spread_bps", "absorbed_ask", "oi_change"), X).collect()
    assert plain and {(r.signs, r.score) for r in plain} == {("", 0)}
    wide = {r[2] for r in bars(1) if r[9] > 5}
    assert not wide & {r.n for r in exhaustion.buyer_exhaustion(df, X).collect()}
