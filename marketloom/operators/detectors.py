"""Pattern detectors: predicate plans over one wide row a bar, then scores and the best candidate.

Each detector is a function of named columns and gives a nullable struct (side, entry, stop, target). A
missing input takes the default that the detector names, at the place where it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = "struct<detector:string,side:string,entry:double,stop:double,target:double>"


def col(name: str, default: float | bool | str | None = None) -> Column:
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def candidate(name: str, side: str, when: Column, entry: Column, stop: Column, target: Column) -> Column:
    made = F.struct(F.lit(name).alias("detector"), F.lit(side).alias("side"), entry.cast("double").alias("entry"), stop.cast("double").alias("stop"), target.cast("double").alias("target"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def reward_ratio(entry: Column, stop: Column, target: Column) -> Column:
    return F.try_divide(F.abs(target - entry), F.abs(entry - stop))


def session_breakout(least_slope: float = 0.0, reward: float = 1.0) -> list[Column]:
    """Close beyond the 20-bar extreme before it in the first hours of a session, with flow behind it."""
    px, atr, opening = col("close"), col("atr"), F.col("region").isin("london", "overlap", "new_york")
    up, down = px > col("prev_high20"), px < col("prev_low20")
    return [
        candidate("session_breakout", "long", opening & up & (col("cvd_slope", 0.0) > least_slope) & (col("taker", 0.0) > 0), px, px - 0.5 * atr, px + reward * atr),
        candidate("session_breakout", "short", opening & down & (col("cvd_slope", 0.0) < -least_slope) & (col("taker", 0.0) < 0), px, px + 0.5 * atr, px - reward * atr),
    ]


def range_reversal() -> list[Column]:
    """Sweep of the extreme before the bar that closes back inside, against the bar's flow."""
    px, atr = col("close"), col("atr")
    return [
        candidate("range_reversal", "long", col("swept_low", False) & (col("delta", 0) < 0), px, col("low") - 0.25 * atr, px + 2 * (px - col("low") + 0.25 * atr)),
        candidate("range_reversal", "short", col("swept_high", False) & (col("delta", 0) > 0), px, col("high") + 0.25 * atr, px - 2 * (col("high") + 0.25 * atr - px)),
    ]


def value_failed_auction() -> list[Column]:
    """Back below the value area's high after a close beyond it, with selling; the mirror at its low."""
    px, atr = col("close"), col("atr")
    short = (px < col("value_high")) & (col("prev_close") > col("value_high")) & (col("delta", 0) < 0)
    long = (px > col("value_low")) & (col("prev_close") < col("value_low")) & (col("delta", 0) > 0)
    return [
        candidate("value_failed_auction", "short", short, px, F.greatest(col("value_high") + 0.25 * atr, col("high")), col("poc")),
        candidate("value_failed_auction", "long", long, px, F.least(col("value_low") - 0.25 * atr, col("low")), col("poc")),
    ]


def vwap_pullback() -> list[Column]:
    """Touch of the session VWAP in a trend that closes on the trend's side, with flow."""
    px, atr = col("close"), col("atr")
    up = (col("regime", "chop") == "trend_up") & (col("low") <= col("vwap")) & (px > col("vwap")) & (col("delta", 0) > 0)
    down = (col("regime", "chop") == "trend_down") & (col("high") >= col("vwap")) & (px < col("vwap")) & (col("delta", 0) < 0)
    return [
        candidate("vwap_pullback", "long", up, px, F.least(col("low"), col("vwap")) - 0.5 * atr, col("upper2")),
        candidate("vwap_pullback", "short", down, px, F.greatest(col("high"), col("vwap")) + 0.5 * atr, col("lower2")),
    ]


def divergence_reversal(least: int = 2) -> list[Column]:
    """A run of price against cumulative delta, faded unless a trend carries it."""
    px, atr = col("close"), col("atr")
    return [
        candidate("divergence_reversal", "short", (col("divergence", 0) >= least) & (col("regime", "chop") != "trend_up"), px, px + atr, px - 2 * atr),
        candidate("divergence_reversal", "long", (col("divergence", 0) <= -least) & (col("regime", "chop") != "trend_down"), px, px - atr, px + 2 * atr),
    ]


def range_breakout(least_ratio: float = 1.5) -> list[Column]:
    """Close out of the range of the bars before it on large volume with delta on the same side."""
    px, atr, big = col("close"), col("atr"), col("volume_ratio", 0.0) >= least_ratio
    middle = (col("prev_high20") + col("prev_low20")) / 2
    return [
        candidate("range_breakout", "long", big & (px > col("prev_high20")) & (col("delta", 0) > 0), px, F.greatest(middle, px - 2 * atr), px + 3 * atr),
        candidate("range_breakout", "short", big & (px < col("prev_low20")) & (col("delta", 0) < 0), px, F.least(middle, px + 2 * atr), px - 3 * atr),
    ]


DETECTORS: dict[str, Callable[[], list[Column]]] = {
    "range_reversal": range_reversal,
    "value_failed_auction": value_failed_auction,
    "session_breakout": session_breakout,
    "vwap_pullback": vwap_pullback,
    "divergence_reversal": divergence_reversal,
    "range_breakout": range_breakout,
}


def score() -> Column:
    """Additive evidence between 0 and 1 for a candidate ``c``: reward, flow on its side, volume, and the trend's agreement."""
    sign = F.when(F.col("c.side") == "long", 1).otherwise(-1)
    reward = F.least(F.lit(1.0), reward_ratio(F.col("c.entry"), F.col("c.stop"), F.col("c.target")) / 3)
    flow = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sign * col("taker", 0.0)))
    volume = F.least(F.lit(1.0), col("volume_ratio", 1.0) / 3)
    trend = F.when((col("regime", "chop") == "trend_up") & (sign > 0) | (col("regime", "chop") == "trend_down") & (sign < 0), 1.0).otherwise(0.0)
    return 0.4 * reward + 0.3 * flow + 0.15 * volume + 0.15 * trend


def route(context: DataFrame, enabled: list[str] | None = None, least_reward: float = 1.0) -> DataFrame:
    """The best candidate of each bar: enabled detectors in their order, a gate on reward, then the score; the first wins ties."""
    names = enabled or list(DETECTORS)
    found = F.array_compact(F.array(*[c for n in names for c in DETECTORS[n]()]))
    rows = context.withColumn("_all", found).where(F.size("_all") > 0).select("*", F.posexplode("_all").alias("_i", "c"))
    valid = F.when(F.col("c.side") == "long", (F.col("c.stop") < F.col("c.entry")) & (F.col("c.target") > F.col("c.entry"))).otherwise((F.col("c.stop") > F.col("c.entry")) & (F.col("c.target") < F.col("c.entry")))
    rows = rows.where(valid & (reward_ratio(F.col("c.entry"), F.col("c.stop"), F.col("c.target")) >= least_reward)).withColumn("score", F.round(score(), 9))
    best = rows.groupBy("symbol", "bucket").agg(F.max_by(F.struct("c", "score"), F.struct("score", -F.col("_i"))).alias("b"))
    return best.select("symbol", "bucket", "b.c.*", "b.score")


def near_misses(context: DataFrame, named: dict[str, Column], allowed: int = 1) -> DataFrame:
    """Bars that fail at most ``allowed`` of a detector's conditions, with the names of those."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in named.items()]))
    return context.withColumn("failed", failed).where(F.size("failed").between(1, allowed)).select("symbol", "bucket", "failed")
