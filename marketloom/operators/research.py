"""Bar patterns of research studies, as expressions over bounded windows: big trades, stacked flow, regime, open gaps and blocks above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time, rows


def big_trades(bars: DataFrame, factor: float = 2.5, n: int = 20, least: int = 5, wick: float = 0.30) -> DataFrame:
    """``big_sell`` and ``big_buy``: a side's volume far above the mean of bars, and a wick on the end that it met."""
    mean = F.when(F.count(F.lit(1)).over(rows(1 - n)) >= least, F.avg("volume").over(rows(1 - n)))
    span = F.col("high") - F.col("low") + 1e-9
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    side = lambda qty, part: F.coalesce((F.col(qty) > factor * mean) & (part / span > wick), F.lit(False))
    return bars.withColumns({"big_sell": side("sell_qty", upper), "big_buy": side("buy_qty", lower)})


def stacked(least: int = 3) -> Column:
    """Side of the last ``least`` deltas if they share one."""
    signs = F.collect_list(F.signum("delta").cast("int")).over(rows(1 - least))
    whole = F.size(signs) == least
    return F.when(whole & (F.array_min(signs) == 1), "bullish").when(whole & (F.array_max(signs) == -1), "bearish").otherwise("none")


def upper_median(value: str, n: int = 500) -> Column:
    """The middle of the last ``n`` values in order, the upper one of two."""
    held = F.array_sort(F.collect_list(value).over(rows(1 - n)))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def study_regime(ema: str = "ema", atr: str = "atr", band: float = 0.002, least: int = 3) -> Column:
    """Trend by three closes beyond a band around the EMA, which hides an expansion of the ATR against its mean; chop else. The first bar begins no run."""
    mean = F.when(F.count(F.lit(1)).over(rows(-19)) >= 5, F.avg(atr).over(rows(-19)))
    counts = F.col("n") > 1
    up, down = counts & (F.col("close") > F.col(ema) * (1 + band)), counts & (F.col("close") < F.col(ema) * (1 - band))
    run = lambda test: F.coalesce(F.sum(test.cast("int")).over(rows(1 - least)) == least, F.lit(False))
    wide = F.coalesce(F.col(atr) / (mean + 1e-9) > 1.30, F.lit(False))
    return F.when(run(down), "trend_down").when(run(up), "trend_up").when(wide, "expansion").otherwise("chop")


def gaps_above(bars: DataFrame, n: int = 50, near: float = 0.005) -> DataFrame:
    """``gap_above`` and ``gap_near``: gaps down of the last ``n`` bars that no close has entered since, with their bottom above the close.

    A gap looks up the first close that enters it; a bar reads the gaps of its window that live.
    """
    later = F.collect_list(F.struct("n", "close")).over(rows(0, n))
    top, bottom = F.lag("low", 2).over(by_time()), F.col("high")
    out = bars.withColumns({"_top": top, "_later": later})
    entered = F.get(F.filter("_later", lambda x: (x["close"] >= bottom) & (x["close"] <= F.col("_top"))), F.lit(0))["n"]
    out = out.withColumn("_gap", F.when(F.col("_top") > bottom, F.struct(bottom.alias("bottom"), entered.alias("entered")))).drop("_later")
    alive = F.filter(F.collect_list("_gap").over(rows(-n, 0)), lambda g: (g["entered"].isNull() | (g["entered"] > F.col("n"))) & (g["bottom"] > F.col("close")))
    out = out.withColumn("_alive", alive)
    close_by = F.exists("_alive", lambda g: (g["bottom"] - F.col("close")) / (F.col("close") + 1e-9) < near)
    return out.withColumns({"gap_above": F.size("_alive") > 0, "gap_near": close_by}).drop("_top", "_gap", "_alive")


def block_above(bars: DataFrame, atr: str = "atr", drop: float = 1.5) -> DataFrame:
    """``block_near``: the close lies in the body and upper wick of the last up bar that a fall of three bars confirmed, until a close below its body."""
    by = Window.partitionBy("symbol")
    was = {c: F.lag(c, 3).over(by_time()) for c in ("open", "high", "close", atr)}
    made = (was["close"] > was["open"]) & (was["close"] - F.col("close") > drop * was[atr]) & (F.col("close") < was["open"])
    out = bars.withColumn("_block", F.when(made, F.struct("n", was["high"].alias("high"), was["open"].alias("low"))))
    out = out.withColumn("_block", F.last("_block", True).over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.col("_block.low"), F.col("_block.high")
    gone = F.max((F.col("close") < low * 0.999).cast("int")).over(Window.partitionBy("symbol", "_block.n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) == 1
    return out.withColumn("block_near", F.coalesce(~gone & F.col("close").between(low, high), F.lit(False))).drop("_block")


def displaced(ratio: str = "vr") -> Column:
    """A falling bar that is mostly body, on volume."""
    return F.coalesce((F.col("close") < F.col("open")) & (F.abs(F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1e-9) > 0.65) & (F.col(ratio) > 1.5), F.lit(False))
