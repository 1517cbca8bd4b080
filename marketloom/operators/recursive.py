"""Indicators that recur on their own last value: one ordered pass over a symbol's bars.

A recursion has no parallel form within a symbol, so a symbol is a group; bars (not trades) keep it
small: a year of one-minute bars is half a million rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(bars: DataFrame, value: Column, start: Callable[[float], float], step: Callable[[float, float, int], float], name: str) -> DataFrame:
    """``name``: ``start(x0)``, then ``step(state, x, position)`` for each bar in order."""
    slim = bars.select("symbol", "bucket", value.cast("double").alias("_x"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        state, out = None, []
        for k, x in enumerate(rows["_x"]):
            state = start(x) if k == 0 else step(state, x, k)
            out.append(state)
        return pd.DataFrame({"symbol": rows["symbol"], "bucket": rows["bucket"], name: out})

    return bars.join(slim.groupBy("symbol").applyInPandas(run, f"symbol string, bucket long, {name} double"), ["symbol", "bucket"])


def ema(bars: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Seeded with the first value, without bias correction."""
    k = 2.0 / (n + 1)
    return fold(bars, F.col(column), lambda x: x, lambda s, x, i: k * x + (1 - k) * s, name)


def wilder_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """Running mean of the true range for the first ``n`` bars, then ((n - 1) s + tr) / n."""
    return fold(bars, F.col("tr"), lambda x: x, lambda s, x, i: s + (x - s) / (i + 1) if i < n else ((n - 1) * s + x) / n, name)


def wilder_atr_seeded(bars: DataFrame, n: int = 14, name: str = "atr_seeded") -> DataFrame:
    """Seeded with the first true range."""
    return fold(bars, F.col("tr"), lambda x: x, lambda s, x, i: ((n - 1) * s + x) / n, name)


def pressure(bars: DataFrame, imbalance: Column, name: str = "pressure") -> DataFrame:
    """0.7 of itself and 0.3 of the imbalance in percent, from 0."""
    return fold(bars, imbalance, lambda x: 0.3 * x * 100, lambda s, x, i: 0.7 * s + 0.3 * x * 100, name)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index: Wilder smoothing of the movements, then of their index."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket").reset_index(drop=True)
        out, s, index = [], [0.0, 0.0, 0.0], None
        for k in range(len(rows)):
            if k == 0:
                out.append(None)
                continue
            up, down = rows.high[k] - rows.high[k - 1], rows.low[k - 1] - rows.low[k]
            tr = max(rows.high[k] - rows.low[k], abs(rows.high[k] - rows.close[k - 1]), abs(rows.low[k] - rows.close[k - 1]))
            moves = (up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0, tr)
            s = [a + b if k <= n else a - a / n + b for a, b in zip(s, moves, strict=True)]
            if k < n:
                out.append(None)
                continue
            plus, minus = (100 * s[0] / s[2], 100 * s[1] / s[2]) if s[2] else (0.0, 0.0)
            dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus else 0.0
            index = dx if index is None else ((n - 1) * index + dx) / n
            out.append(index)
        return pd.DataFrame({"symbol": rows["symbol"], "bucket": rows["bucket"], "adx": out})

    slim = bars.select("symbol", "bucket", "high", "low", "close")
    return slim.groupBy("symbol").applyInPandas(run, "symbol string, bucket long, adx double")
