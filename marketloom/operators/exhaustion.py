"""Buyers who tire: a range that they bought, whose flow turns before it breaks down on volume.

All gates but the rest after a signal depend on a bounded window, so they are expressions; the rest is a chain of successors
(``structure.cooldown``), and no state is kept over a symbol's bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import region
from .indicators import rows
from .structure import cooldown


@dataclass(frozen=True)
class Rules:
    """Lengths in bars, the range in percent of the price, the rest as ratios."""

    windows: tuple[int, ...] = (8,)
    narrow: float = 0.05
    wide: float = 0.50
    bought: bool = True
    turn_bars: int = 5
    turn_ratio: float = 0.40
    volume: float = 2.5
    volume_bars: int = 50
    sold: bool = True
    close_in: float | None = 0.35
    body: float | None = 0.35
    wick: float | None = 0.30
    stop_at_high: bool = True
    extension: float = 0.50
    reward: float = 1.80
    rest: int = 60
    sessions: tuple[str, ...] = ("overlap",)


#: Inputs of the second layer that a bar may have, and when each speaks for a fall.
SIGNS = {
    "absorbed_ask": lambda: F.col("absorbed_ask"), "stacked_bear": lambda: F.col("stacked_bear"), "thin_below": lambda: F.col("thin_below"), "oi_change": lambda: F.col("oi_change") < 0,
    "obi10": lambda: F.col("obi10") < -0.05, "obi_mean": lambda: F.col("obi_mean") < -0.05,
}
VETOES = {"spread_bps": lambda: F.col("spread_bps") > 5.0, "bid_wall": lambda: F.col("bid_wall")}


def holds(tests: dict, bars: DataFrame) -> list[Column]:
    return [F.when(F.coalesce(test(), F.lit(False)), F.lit(name)) for name, test in tests.items() if name in bars.columns]


def broken_range(r: Rules, n: int) -> Column:
    """The break of the ``n`` bars before this one, if it is one."""
    high, low, flow = F.max("high").over(rows(-n, -1)), F.min("low").over(rows(-n, -1)), F.sum("delta").over(rows(-n, -1))
    turn = F.sum("delta").over(rows(-min(r.turn_bars, n), -1))
    close, pct = F.col("close"), (high - low) / F.col("close") * 100.0
    ratio = F.when(flow > 0, F.abs(turn) / flow).otherwise(0.0)
    stop = F.greatest(high if r.stop_at_high else (high + low) / 2, F.col("high"))
    target = close - 2.0 * (stop - close)
    ok = pct.between(r.narrow, r.wide) & (turn < 0) & (ratio >= r.turn_ratio) & (close < low) & ((low - close) / (high - low) <= r.extension)
    ok = ok & (stop - close > 1e-10) & (F.col("low") > target) & ((close - target) / (stop - close) >= r.reward)
    if r.bought:
        ok = ok & (flow > 0)
    made = F.struct(F.lit(n).alias("range_bars"), high.alias("range_high"), low.alias("range_low"), pct.alias("range_pct"), flow.alias("range_cvd"), turn.alias("turn_cvd"), ratio.alias("turn_ratio"), stop.alias("stop"), target.alias("target"))
    return F.when(ok, made)


def buyer_exhaustion(bars: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Shorts from ``symbol, bucket, n, open, high, low, close, volume, delta`` and what second-layer inputs there are; the shortest range that breaks counts."""
    r = rules or Rules()
    base = rows(-(r.volume_bars + 4))
    b = bars.withColumns({"volume_ratio": F.coalesce(F.try_divide("volume", F.avg("volume").over(base)), F.lit(0.0)), "_range": F.coalesce(*[broken_range(r, n) for n in r.windows])})
    span, top = F.col("high") - F.col("low"), F.greatest("open", "close")
    shape = F.lit(True)
    if r.close_in is not None:
        shape = shape & ((F.col("close") - F.col("low")) / span <= r.close_in)
    if r.body is not None:
        shape = shape & (F.greatest(F.col("open") - F.col("close"), F.lit(0.0)) / span >= r.body)
    if r.wick is not None:
        shape = shape & ((F.col("high") - top) / span <= r.wick)
    ok = (F.col("n") >= r.volume_bars + max(r.windows)) & (F.col("volume_ratio") >= r.volume) & region(F.col("bucket")).isin(*r.sessions) & F.when(span > 1e-10, shape).otherwise(True)
    if r.sold:
        ok = ok & (F.col("delta") < 0)
    vetoes = F.array_compact(F.array(*holds(VETOES, bars))) if holds(VETOES, bars) else F.array().cast("array<string>")
    signs = F.array_compact(F.array(*holds(SIGNS, bars))) if holds(SIGNS, bars) else F.array().cast("array<string>")
    b = b.where(ok & F.col("_range").isNotNull() & (F.size(vetoes) == 0))
    found = b.select("symbol", "bucket", "n", F.col("close").alias("entry"), "_range.*", "volume_ratio", F.col("delta").alias("break_delta"), F.concat_ws(",", signs).alias("signs"), F.size(signs).alias("score"))
    return cooldown(found, "symbol", "n", r.rest, 4096)
