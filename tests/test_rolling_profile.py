"""Profiles that move with the bars, against profiles that are counted anew for each bar."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import rolling_profile as op


def anew(close, volume, i, window, bins):
    """A bar's profile from the whole window before it."""
    x, v = close[i - window : i], volume[i - window : i]
    if x.max() - x.min() < 1e-6:
        return None
    counts, edges = np.histogram(x, bins=np.linspace(x.min(), x.max(), bins + 1), weights=v)
    middle, poc = (edges[:-1] + edges[1:]) / 2, int(np.argmax(counts))
    low = high = poc
    inside = counts[poc]
    while inside < counts.sum() * 0.70 and (low > 0 or high < bins - 1):
        up, down = counts[high + 1] if high < bins - 1 else -1, counts[low - 1] if low > 0 else -1
        if up >= down:
            high, inside = high + 1, inside + up
        else:
            low, inside = low - 1, inside + down
    under = np.flatnonzero(edges[1:] <= close[i])
    thin = middle[min(under, key=lambda k: (counts[k], k))] if len(under) else None
    return middle[poc], middle[high], middle[low], thin


def walk(seed, n, flat=0):
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 0.4, n)), 1)  # rounded, so that closes lie on edges
    close[:flat] = 100.0
    return close, rng.integers(0, 50, n)


@pytest.mark.parametrize(("window", "bins"), [(1, 2), (20, 7), (60, 50), (300, 50)])
def test_moving_counts_equal_counts_anew(window, bins):
    close, volume = walk(window, 900, flat=window + 30)
    rows = pd.DataFrame({"n": np.arange(1, 901), "close": close, "volume": volume})
    got = {n: levels for n, *levels in op.moving(rows, 1, window, bins)}
    wanted = {i + 1: anew(close, volume, i, window, bins) for i in range(window, 900)}
    wanted = {n: v for n, v in wanted.items() if v is not None}
    assert set(got) == set(wanted)
    for n, v in wanted.items():
        assert got[n] == pytest.approx(v)


def test_windows_are_seldom_counted_anew():
    """Work in proportion to the bars: only new extremes move the bins."""
    close, volume = walk(1, 20_000)
    state = op.Moving(close, volume, 300, 50)
    before = pd.Series(close).rolling(300)
    low, high = before.min().shift(1).to_numpy(), before.max().shift(1).to_numpy()
    for i in range(300, 20_000):
        state.step(i, low[i], high[i])
    assert state.recounts < 20_000 / 8 and state.counts.sum() == volume[-301:-1].sum()


def test_chunks_give_what_one_pass_gives(spark):
    rows = [(s, k + 1, float(c), int(v)) for s in "ab" for k, (c, v) in enumerate(zip(*walk(ord(s), 500), strict=True))]
    df = spark.createDataFrame(rows, "symbol string, n long, close double, volume long")
    whole = {(r.symbol, r.n): tuple(r)[4:] for r in op.rolling_profile(df, 50, 10).collect()}
    for chunk in (1000, 64, 37):  # 37: a window reaches over several chunks
        assert {(r.symbol, r.n): tuple(r)[4:] for r in op.rolling_profile(df, 50, 10, chunk).collect()} == whole
    assert len(whole) == 1000 and all((v[0] is None) == (n <= 50) for (_, n), v in whole.items())


def test_a_period_fixes_its_bins_with_its_first_range():
    bars = pd.DataFrame({"symbol": "s", "bucket": range(4), "high": [10.0, 20.0, 30.0, 11.0], "low": [10.0, 10.0, 15.0, 10.0], "volume": [5.0, 10.0, 30.0, 7.0]})
    got = op.period_levels(bars, 10)
    assert got.loc[0].isna()[["poc", "value_high", "value_low"]].all()  # no range yet
    # bins of one from 10 to 20: one each of the second bar; equal ones take the highest, and grow down
    assert got.loc[1, ["poc", "value_high", "value_low"]].tolist() == [19.5, 19.5, 13.5]
    # the third bar has 2 a price; what lies above 20 is lost
    assert got.loc[2, ["poc", "value_high", "value_low"]].tolist() == [19.5, 19.5, 15.5]
    assert got.loc[3, "poc"] == 10.5


def test_period_levels_equal_running_bins(spark):
    rng = random.Random(4)
    rows, x = [], 50.0
    for k in range(400):
        x += rng.uniform(-1, 1)
        rows.append(("s", k * op.WEEK // 100, x + rng.choice([0, 0.5, 2]), x - rng.choice([0, 1]), x, float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "symbol string, bucket long, high double, low double, close double, volume double")
    got = {r.bucket: (r.w_poc, r.w_value_high, r.w_value_low, r.w_location) for r in op.period_profile(df, op.WEEK, "w", 8).collect()}
    state, period = None, None
    for _, bucket, high, low, close, volume in rows:
        if bucket // op.WEEK != period:
            period, state, top, bottom = bucket // op.WEEK, None, high, low
        top, bottom = max(top, high), min(bottom, low)
        if state is None and top > bottom:
            state, base, step = [0] * 8, bottom, (top - bottom) / 8
        if state is not None:
            for k in range(8):
                middle = base + k * step + step * 0.5
                shared = min(high, middle + step * 0.5) - max(low, middle - step * 0.5)
                state[k] += round(volume * max(shared, 0.0) / max(high - low, step * 0.1) * op.UNIT)
        if state is None or not any(state):
            assert got[bucket] == (None, None, None, None)
            continue
        poc = max(range(8), key=lambda k: (state[k], k))
        lo = hi = poc
        while sum(state[lo : hi + 1]) < sum(state) * 0.70 and (lo, hi) != (0, 7):
            if lo > 0 and (hi == 7 or state[lo - 1] >= state[hi + 1]):
                lo -= 1
            else:
                hi += 1
        at = lambda k: base + k * step + step * 0.5  # noqa: E731, B023
        assert got[bucket][:3] == pytest.approx((at(poc), at(hi), at(lo)))
        assert got[bucket][3] == ("above_value" if close > at(hi) else "below_value" if close < at(lo) else "in_value")
