"""Indicators of bounded windows over bars (symbol, bucket, open, high, low, close, buy_qty, sell_qty, volume, delta).

Definitions that share a name elsewhere are separate functions here; their frames, guards and deviations
(population or sample) are part of their meaning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.clocks import DAY, SESSIONS, in_session


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bucket")


def rows(first: int, last: int = 0) -> WindowSpec:
    return by_time().rowsBetween(first, last)


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol", F.floor(F.col("bucket") / DAY)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def session_vwap(bars: DataFrame) -> DataFrame:
    """VWAP from the start of the UTC day with bands of one and two deviations; the close where nothing traded."""
    w, tp, v = by_day(), typical(), F.col("volume")
    total = F.sum(v).over(w)
    vwap = F.coalesce(F.try_divide(F.sum(tp * v).over(w), total), F.col("close"))
    var = F.coalesce(F.try_divide(F.sum(tp * tp * v).over(w), total) - vwap * vwap, F.lit(0.0))
    out = bars.withColumn("vwap", vwap).withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), var)))
    bands = {f"{side}{k}": F.col("vwap") + sign * k * F.col("sigma") for k in (1, 2) for side, sign in (("upper", 1), ("lower", -1))}
    return out.withColumns(bands)


def session_vwaps(bars: DataFrame) -> DataFrame:
    """One VWAP for each session clock of the day; null outside. London and New York overlap."""
    out = bars
    for name in SESSIONS:
        inside = in_session(F.col("bucket"), name)
        w = Window.partitionBy("symbol", F.floor(F.col("bucket") / DAY), inside).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        value = F.try_divide(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w))
        out = out.withColumn(f"vwap_{name}", F.when(inside, value))
    return out


def cvd(bars: DataFrame, daily: bool = True) -> DataFrame:
    """Cumulative delta, from the start of the day or of the series."""
    return bars.withColumn("cvd", F.sum("delta").over(by_day() if daily else rows(Window.unboundedPreceding)))


def slope(value: str, n: int, least: int) -> Column:
    """Least-squares slope over the last ``n`` bars, null under ``least``."""
    w = rows(-(n - 1))
    return F.when(F.count(value).over(w) >= least, F.regr_slope(F.col(value), F.col("n")).over(w))


def with_number(bars: DataFrame) -> DataFrame:
    return bars.withColumn("n", F.row_number().over(by_time()))


def vpin_share(n: int = 20) -> Column:
    """Sum of |buy - sell| over sum of volume, in percent."""
    w = rows(-(n - 1))
    return F.coalesce(F.try_divide(F.sum(F.abs("delta")).over(w), F.sum("volume").over(w)) * 100, F.lit(0.0))


def vpin_mean(n: int = 50) -> Column:
    """Mean of each bar's |delta| / volume, bars without volume left out."""
    return F.avg(F.try_divide(F.abs("delta"), "volume")).over(rows(-(n - 1)))


def buy_share(n: int = 50, least: int = 10) -> Column:
    """Buys' share of volume, 0.5 until ``least`` bars are there."""
    w = rows(-(n - 1))
    return F.when(F.count(F.lit(1)).over(w) >= least, F.coalesce(F.try_divide(F.sum("buy_qty").over(w), F.sum("volume").over(w)), F.lit(0.5))).otherwise(0.5)


def bar_vpin() -> Column:
    return F.try_divide(F.abs("delta"), F.col("buy_qty") + F.col("sell_qty"))


def empirical_share(value: Column, n: int = 50, least: int = 3) -> Column:
    """Share of the last ``n`` values that are at most the current one."""
    seen = F.filter(F.collect_list(value).over(rows(-(n - 1))), lambda x: x.isNotNull())
    return F.when((F.size(seen) >= least) & value.isNotNull(), F.size(F.filter(seen, lambda x: x <= value)) / F.size(seen))


def ratio_to_previous(n: int) -> Column:
    """Volume over the mean of the ``n`` bars before, 1 for the first."""
    return F.coalesce(F.try_divide(F.col("volume"), F.avg("volume").over(rows(-n, -1))), F.lit(1.0))


def ratio_with_current(n: int, least: int = 1) -> Column:
    w = rows(-(n - 1))
    return F.when(F.count(F.lit(1)).over(w) >= least, F.try_divide(F.col("volume"), F.avg("volume").over(w)))


def z_score(value: str, n: int, least: int, population: bool = True) -> Column:
    """0 under ``least`` bars or with no deviation."""
    w = rows(-(n - 1))
    std = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return F.when((F.count(value).over(w) >= least) & (std >= 1e-9), (F.col(value) - F.avg(value).over(w)) / std).otherwise(0.0)


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    spread = F.col("high") - F.col("low")
    return F.coalesce(F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before)), spread)


def atr_mean(n: int = 14) -> Column:
    """Mean true range of the last ``n`` bars; the first bar has none."""
    known = F.when(F.lag("close").over(by_time()).isNotNull(), F.col("tr"))
    return F.avg(known).over(rows(-(n - 1)))


def runs_of(sign: Column, name: str) -> dict[str, Column]:
    """Columns for ``withColumns`` in turn: a change flag and its group, so that a run's length is a row number in it."""
    return {f"_{name}": (sign != F.coalesce(F.lag(sign).over(by_time()), F.lit(99))).cast("int")}


def run_length(bars: DataFrame, sign: Column, name: str) -> DataFrame:
    """Signed length of the run of equal ``sign`` (-1, 0, 1) that ends in each bar; 0 for sign 0."""
    out = bars.withColumn("_s", sign)
    out = out.withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(by_time()), F.lit(99))).cast("int"))
    out = out.withColumn("_run", F.sum("_new").over(rows(Window.unboundedPreceding)))
    length = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("bucket"))
    return out.withColumn(name, (length * F.col("_s")).cast("long")).drop("_s", "_new", "_run")


def divergence_sign() -> Column:
    """1 where price rose and cumulative delta did not, -1 where delta rose and price did not, else 0."""
    up = F.col("close") > F.lag("close").over(by_time())
    flow = F.col("cvd") > F.lag("cvd").over(by_time())
    return F.coalesce(F.when(up & ~flow, 1).when(~up & flow, -1), F.lit(0))


def efficiency(n: int) -> Column:
    """Net change over the sum of absolute changes of ``n`` steps."""
    step = F.abs(F.col("close") - F.col("prev_close"))
    return F.try_divide(F.abs(F.col("close") - F.lag("close", n).over(by_time())), F.sum(step).over(rows(-(n - 1))))


def choppiness(n: int = 14) -> Column:
    w = rows(-(n - 1))
    spread = F.max("high").over(w) - F.min("low").over(w)
    return F.when((F.count("tr").over(w) >= n) & (spread > 0), 100 * F.log10(F.sum("tr").over(w) / spread) / F.log10(F.lit(float(n))))


def reversals(n: int) -> Column:
    """Changes of direction within the last ``n`` bars."""
    turn = (F.col("close") - F.col("prev_close")) * (F.col("prev_close") - F.lag("prev_close").over(by_time())) < 0
    return F.sum(turn.cast("int")).over(rows(-(n - 1)))


def trailing_sums(events: DataFrame, width_ms: int, short_ms: int, cascade: float, dominant: float) -> DataFrame:
    """Sums by side over the last ``width_ms`` up to each event (symbol, ts_ms, seq, is_sell, usd), by event time.

    A cascade is a short sum above its level; a side dominates with more than its share.
    """
    slots = F.floor(F.col("ts_ms") / width_ms).cast("long")
    # an event counts in its own slot and as history of the next one, so a task holds two widths of a symbol
    placed = events.select("symbol", "ts_ms", "seq", "is_sell", F.col("usd").cast("double").alias("usd"), F.posexplode(F.array(slots, slots + 1)).alias("_past", "_slot"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["ts_ms", "seq"], kind="stable")
        ts, usd, sell = x["ts_ms"].to_numpy(), x["usd"].to_numpy(), x["is_sell"].to_numpy()
        end = np.searchsorted(ts, ts, "right")
        own = x["_past"].to_numpy() == 0

        def over(values: np.ndarray, ms: int) -> np.ndarray:
            total = np.append(np.longdouble(0), np.cumsum(values.astype(np.longdouble)))  # exact enough for differences
            return (total[end] - total[np.searchsorted(ts, ts - ms, "left")]).astype(np.float64)

        known = ~np.isnan(usd)
        of = [over(np.where(known & (sell == which), usd, 0.0), width_ms) for which in (True, False)]
        short, many = over(np.where(known, usd, 0.0), short_ms), over(known, short_ms)
        cascades = pd.array(short > cascade, dtype="boolean")
        cascades[many == 0] = pd.NA
        out = pd.DataFrame({"symbol": x["symbol"].to_numpy(), "ts_ms": ts, "seq": x["seq"].to_numpy(), "sells": of[0], "buys": of[1], "cascade": cascades})
        return out[own]

    out = placed.groupBy("symbol", "_slot").applyInPandas(run, "symbol string, ts_ms long, seq long, sells double, buys double, cascade boolean")
    side = F.when(F.col("sells") > dominant * (F.col("sells") + F.col("buys")), "sell").when(F.col("buys") > dominant * (F.col("sells") + F.col("buys")), "buy").otherwise("none")
    return out.withColumn("dominant", side)


def forward_returns(bars: DataFrame, steps: tuple[int, ...], horizon: int) -> DataFrame:
    """Returns in basis points after each number of bars, and the best and worst excursion within the horizon."""
    ahead = rows(1, horizon)
    out = {f"fwd_{k}": (F.lead("close", k).over(by_time()) / F.col("close") - 1) * 1e4 for k in steps}
    out["mfe"] = (F.max("high").over(ahead) / F.col("close") - 1) * 1e4
    out["mae"] = (F.min("low").over(ahead) / F.col("close") - 1) * 1e4
    return bars.withColumns(out)


def smart_money(ls: Column, oi: Column, funding: Column, cascade: Column) -> Column:
    """Weighted score of three signals in [-1, 1], none during a cascade."""
    return F.when(cascade, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * ls + 0.2 * oi + 0.3 * funding)))
