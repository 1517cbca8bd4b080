"""Auctions around value: failed acceptance, absorption, gaps of one side, divergences, opening bias of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import opening_bias
from .indicators import by_time, rows


def failed_acceptance(bars: DataFrame) -> DataFrame:
    """``failed``, ``absorption``: a high beyond ``value_high`` in the last three bars with the close back below it, else the mirror.

    Absorption is judged at the last such bar: its delta on the breaking side while ``cvd_slope`` does not follow.
    """
    w = rows(-2)
    slope = F.coalesce("cvd_slope", F.lit(0.0))
    last = F.collect_list(F.struct("high", "low", "delta")).over(w)
    beyond = lambda test: F.element_at(F.filter(last, test), -1)
    up = F.when(F.exists(last, lambda b: b["high"] > F.col("value_high")), beyond(lambda b: b["high"] > F.col("value_high"))["delta"])
    down = F.when(F.exists(last, lambda b: b["low"] < F.col("value_low")), beyond(lambda b: b["low"] < F.col("value_low"))["delta"])
    out = bars.withColumns({"_up": F.when(F.col("close") < F.col("value_high"), up), "_down": F.when(F.col("close") > F.col("value_low"), down)})
    side = F.when(F.col("_up").isNotNull(), F.when((F.col("_up") > 0) & (slope <= 0), "ask").otherwise("none"))
    side = side.when(F.col("_down").isNotNull() & (F.col("_down") < 0) & (slope >= 0), "bid").otherwise("none")
    failed = F.col("_up").isNotNull() | F.col("_down").isNotNull()
    return out.withColumns({"failed": failed, "absorption": side}).drop("_up", "_down")


def edge_absorption(cells: DataFrame, bars: DataFrame, band: float = 0.35, flat: float = 0.05) -> DataFrame:
    """``side`` for each bar (value_high, value_low, atr, cvd_slope; prices as levels): delta at a value edge that the slope does not follow.

    ``cells`` (symbol, bucket, level, buy_qty, sell_qty); each cell meets its own bar only.
    """
    edge = band * F.col("atr")
    met = cells.join(bars.select("symbol", "bucket", "value_high", "value_low", "atr", "cvd_slope"), ["symbol", "bucket"])
    delta = F.col("buy_qty") - F.col("sell_qty")
    sums = met.groupBy("symbol", "bucket").agg(
        F.sum(F.when(F.col("level") >= F.col("value_high") - edge, delta).otherwise(0)).alias("at_high"),
        F.sum(F.when(F.col("level") <= F.col("value_low") + edge, delta).otherwise(0)).alias("at_low"), F.first("atr").alias("atr"), F.first("cvd_slope").alias("slope"),
    )
    slope = F.coalesce("slope", F.lit(0.0))
    side = F.when(F.col("atr") <= 0, "unknown").when((F.col("at_high") > 0) & (slope <= flat), "ask").when((F.col("at_low") < 0) & (slope >= -flat), "bid").otherwise("none")
    return sums.select("symbol", "bucket", "at_high", "at_low", side.alias("side"))


def one_sided_gap(cells: DataFrame, n: int) -> DataFrame:
    """The first run of ``n`` levels in price order where one side did not trade at all; buckets of fewer levels are unknown."""
    kind = F.when((F.col("sell_qty") <= 0) & (F.col("buy_qty") > 0), 1).when((F.col("buy_qty") <= 0) & (F.col("sell_qty") > 0), -1).otherwise(0)
    w = Window.partitionBy("symbol", "bucket").orderBy("level")
    c = cells.select("symbol", "bucket", "level", kind.alias("kind"))
    c = c.withColumn("run", F.sum((F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(9))).cast("int")).over(w))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("symbol", "bucket", "run").orderBy("level")))
    met = (F.col("kind") != 0) & (F.col("nth") == n)
    found = c.groupBy("symbol", "bucket").agg(F.min_by(F.when(met, F.col("kind")), F.when(met, F.col("level"))).alias("k"), F.count(F.lit(1)).alias("levels"))
    side = F.when(F.col("levels") < n, "unknown").when(F.col("k") == 1, "bullish").when(F.col("k") == -1, "bearish").otherwise("none")
    return found.select("symbol", "bucket", side.alias("side"))


def halves_divergence(n: int = 10, margin: float = 0.0001, least: float = 0.5) -> Column:
    """New extreme of the later half of ``n`` bars while ``cvd_slope`` runs against it."""
    half = n // 2
    early, late = rows(-(n - 1), -half), rows(-(half - 1))
    ready = F.count(F.lit(1)).over(rows(-(n - 1))) >= n
    up = (F.max("high").over(late) > F.max("high").over(early) * (1 + margin)) & (F.col("cvd_slope") < -least)
    down = (F.min("low").over(late) < F.min("low").over(early) * (1 - margin)) & (F.col("cvd_slope") > least)
    return F.when(ready & up, "bearish").when(ready & down, "bullish")


def swing_divergence(bars: DataFrame, lookback: int = 30, least: float = 0.1) -> DataFrame:
    """The stronger divergence of the last two swings within ``lookback`` bars (columns n, high, low, cvd).

    A swing is no lower than two bars before it and the one after; the newest bar is none yet.
    Strength is the gap of cvd between the swings in units of its mean size; ties are bearish.
    """
    w = by_time()
    out = bars
    for name, price, sign in (("top", F.col("high"), 1), ("low", -F.col("low"), -1)):
        p = price
        swing = (p >= F.lag(p, 1).over(w)) & (p >= F.lag(p, 2).over(w)) & (p >= F.lead(p, 1).over(w))
        here = F.when(swing, F.struct("n", p.alias("p"), (sign * F.col("cvd")).alias("c")))
        out = out.withColumn(f"_{name}", here).withColumn(f"_{name}_before", F.last(f"_{name}", True).over(rows(Window.unboundedPreceding, -1)))
        pair = F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}").alias("a"), F.col(f"_{name}_before").alias("b")))
        out = out.withColumn(f"_{name}_pair", pair).withColumn(f"_{name}_seen", F.last(f"_{name}_pair", True).over(rows(Window.unboundedPreceding, -1)))
    size = F.avg(F.abs("cvd")).over(rows(-(lookback - 1)))
    ready = (F.count(F.lit(1)).over(rows(-(lookback - 1))) >= lookback) & (size >= 1e-9)

    def strength(name: str) -> Column:
        a, b = F.col(f"_{name}_seen.a"), F.col(f"_{name}_seen.b")
        s = F.when(ready & (b["n"] >= F.col("n") - lookback + 3) & (a["p"] >= b["p"]) & (a["c"] < b["c"]), (b["c"] - a["c"]) / size)
        return F.when(s >= least, s)

    top, low = strength("top"), strength("low")
    kind = F.when(top.isNotNull() & (low.isNull() | (top >= low)), "bearish").when(low.isNotNull(), "bullish")
    out = out.withColumns({"strength": F.greatest(top, low), "divergence": kind})
    ago = F.col("n") - F.when(F.col("divergence") == "bearish", F.col("_top_seen.a.n")).when(F.col("divergence") == "bullish", F.col("_low_seen.a.n"))
    level = F.when(F.col("divergence") == "bearish", F.col("_top_seen.a.p")).when(F.col("divergence") == "bullish", -F.col("_low_seen.a.p"))
    return out.withColumns({"bars_ago": ago, "level": level}).drop(*[c for c in out.columns if c.startswith(("_top", "_low"))])


def streak_context(bars: DataFrame, quiet: float = 0.7, never: int = 9999) -> DataFrame:
    """Bars in a row of negative and of positive delta, the delta before, and bars since the last with ``vr`` under ``quiet``."""
    w, ever = by_time(), rows(Window.unboundedPreceding)
    since = lambda stop: F.col("n") - F.coalesce(F.max(F.when(stop, F.col("n"))).over(ever), F.lit(0))
    quiet_at = F.max(F.when(F.col("vr") < quiet, F.col("n"))).over(ever)
    return bars.withColumns(
        {
            "run_negative": since(F.col("delta") >= 0), "run_positive": since(F.col("delta") <= 0), "prev_delta": F.lag("delta", 1, 0).over(w),
            "since_quiet": F.least(F.coalesce(F.col("n") - quiet_at, F.lit(never)), F.lit(never)),
        }
    )


def daily_bias(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bias of each bar from its day's open and the day before (symbol, day, poc, value_low, value_high, low, high).

    A day that opens outside value is judged anew, once, when a later bar meets the value area. The day before is the
    last one that has a session.
    """
    order = Window.partitionBy("symbol").orderBy("day")
    prev = sessions.select("symbol", "day", *[F.col(c).alias(f"p_{c}") for c in ("value_low", "value_high", "low", "high")])
    nexts = prev.withColumn("day", F.lead("day").over(order))
    b = bars.withColumn("day", F.floor(F.col("bucket") / 86_400_000).cast("long")).join(nexts, ["symbol", "day"], "left")
    w = Window.partitionBy("symbol", "day").orderBy("bucket")
    meets = (F.col("low") <= F.col("p_value_high")) & (F.col("high") >= F.col("p_value_low")) | F.col("open").between(F.col("p_value_low"), F.col("p_value_high"))
    later = w.rowsBetween(Window.unboundedPreceding, 0)
    accepted = F.max((F.row_number().over(w) > 1) & meets)
    b = b.withColumn("_meets", (F.row_number().over(w) > 1) & meets).withColumn("session_open", F.first("open").over(later))
    accepted = F.coalesce(F.max("_meets").over(later), F.lit(False))
    bias = F.when(F.col("p_low").isNotNull(), opening_bias(F.col("session_open"), F.col("p_value_low"), F.col("p_value_high"), F.col("p_low"), F.col("p_high"), accepted))
    return b.withColumn("bias", bias).drop("_meets", "p_value_low", "p_value_high", "p_low", "p_high")


def stress_ranges(n: int = 20) -> tuple[Column, Column]:
    """Whether a bar's range is over twice the mean of those before it, and whether it is under one and a half times that."""
    size = F.col("high") - F.col("low")
    mean = F.avg(size).over(rows(-(n - 1), -1))
    return F.coalesce(size > 2 * mean, F.lit(False)), F.coalesce(size < 1.5 * mean, F.lit(False))
