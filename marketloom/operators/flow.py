"""Order flow and context: anchored averages, slots within candles, stacked imbalances, ranges, funding, targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time, rows, typical


def anchored_vwap(bars: DataFrame, anchor: Column, name: str = "anchored_vwap") -> DataFrame:
    """VWAP from the last bar at which ``anchor`` held, that bar included; null before the first."""
    out = bars.withColumn("_group", F.sum(F.coalesce(anchor, F.lit(False)).cast("int")).over(rows(Window.unboundedPreceding)))
    w = Window.partitionBy("symbol", "_group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.try_divide(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w))
    return out.withColumn(name, F.when(F.col("_group") > 0, value)).drop("_group")


def swing_low_anchor() -> Column:
    """A strict three-bar low, which is known one bar later."""
    low = F.lag("low", 1).over(by_time())
    return (low < F.lag("low", 2).over(by_time())) & (low < F.col("low"))


def break_anchor(n: int = 300) -> Column:
    """A close beyond all extremes of the bars before it."""
    w = rows(-(n - 1), -1)
    return (F.col("close") > F.max("high").over(w)) | (F.col("close") < F.min("low").over(w))


def delta_velocity(n: int = 5) -> Column:
    """Slope of the last ``n`` deltas in units of the mean true range; needs columns ``n`` and ``tr``."""
    w = rows(-(n - 1))
    return F.when(F.count("delta").over(w) >= n, F.try_divide(F.regr_slope(F.col("delta"), F.col("n")).over(w), F.avg("tr").over(rows(-13))))


def micro_slots(trades: DataFrame, candle_ms: int, slot_ms: int) -> DataFrame:
    """Trades of each slot of a candle; slots without trades are rows of zeros."""
    slots = candle_ms // slot_ms
    t = trades.select("symbol", "price", "qty", "is_sell", "ts_ms", "seq", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(candle_ms))).alias("candle"))
    t = t.withColumn("slot", F.floor((F.col("ts_ms") - F.col("candle")) / slot_ms).cast("int"))
    sums = t.groupBy("symbol", "candle", "slot").agg(
        F.sum(F.when(F.col("is_sell"), 0).otherwise(F.col("qty"))).alias("buy_qty"), F.sum(F.when(F.col("is_sell"), F.col("qty")).otherwise(0)).alias("sell_qty"),
        F.max_by("price", F.struct("ts_ms", "seq")).alias("close"),
    )
    grid = sums.select("symbol", "candle").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return grid.join(sums, ["symbol", "candle", "slot"], "left").fillna(0, ["buy_qty", "sell_qty"])


def micro_window(slots: DataFrame) -> DataFrame:
    """A candle's path through its slots: net delta, sign changes, the half that carried it, and how it was spread."""
    delta = F.col("buy_qty") - F.col("sell_qty")
    path = slots.groupBy("symbol", "candle").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", delta.alias("d")))), lambda s: s["d"]).alias("d"))
    total = F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x)
    gross = F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
    signs = F.filter(F.transform("d", lambda x: F.signum(x).cast("int")), lambda s: s != 0)
    flips = F.aggregate(F.zip_with(signs, F.slice(signs, 2, F.size(signs)), lambda a, b: (a * b < 0).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    half = F.aggregate(F.slice("d", 1, (F.size("d") / 2).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = path.select("symbol", "candle", total.alias("delta"), gross.alias("gross"), F.when(F.size(signs) > 0, flips).otherwise(0).alias("flips"), half.alias("first_half"))
    shape = F.when(F.col("gross") == 0, "empty").when(F.abs("delta") * 2 >= F.col("gross"), "one_sided").when(F.col("first_half") * (F.col("delta") - F.col("first_half")) < 0, "reversal").otherwise("mixed")
    return out.withColumn("shape", shape)


def stacked_levels(cells: DataFrame, n: int) -> DataFrame:
    """The first run of ``n`` or more levels in price order with delta on one side, for each bucket."""
    sign = F.signum(F.col("buy_qty") - F.col("sell_qty")).cast("int")
    w = Window.partitionBy("symbol", "bucket").orderBy("level")
    c = cells.select("symbol", "bucket", "level", sign.alias("sign"))
    c = c.withColumn("new", (F.col("sign") != F.coalesce(F.lag("sign").over(w), F.lit(9))).cast("int")).withColumn("run", F.sum("new").over(w))
    found = c.where("sign <> 0").groupBy("symbol", "bucket", "run", "sign").agg(F.min("level").alias("low_level"), F.count(F.lit(1)).alias("levels")).where(F.col("levels") >= n)
    return found.groupBy("symbol", "bucket").agg(F.min_by(F.struct("sign", "low_level", "levels"), "low_level").alias("s")).select("symbol", "bucket", "s.*")


def big_levels(cells: DataFrame, factor: float = 2.5) -> DataFrame:
    """Whether a level with over ``factor`` times the bucket's mean volume lies in the lower or the upper half of its levels."""
    w = Window.partitionBy("symbol", "bucket")
    total = F.col("buy_qty") + F.col("sell_qty")
    c = cells.withColumns({"big": total > factor * F.avg(total).over(w), "upper": F.col("level") * 2 > F.min("level").over(w) + F.max("level").over(w)})
    return c.groupBy("symbol", "bucket").agg(F.bool_or(F.col("big") & ~F.col("upper")).alias("big_low"), F.bool_or(F.col("big") & F.col("upper")).alias("big_high"))


def range_state(bars: DataFrame, n: int = 36) -> DataFrame:
    """Range of the ``n`` bars before each bar, with touches of its ends, and where the bar is: the range excludes the bar,

    so that sweeps and breakouts of it can be seen. Needs ``tr``; without movement (zero ATR) the size is null.
    """
    w = rows(-n, -1)
    out = bars.withColumns({"range_high": F.max("high").over(w), "range_low": F.min("low").over(w), "in_range": F.count(F.lit(1)).over(w), "atr": F.avg("tr").over(rows(-14, -1))})
    size = F.try_divide(F.col("range_high") - F.col("range_low"), F.col("atr"))
    place = (
        F.when(F.col("in_range") < n, "none").when((F.col("low") < F.col("range_low")) & (F.col("close") > F.col("range_low")), "sweep_low")
        .when((F.col("high") > F.col("range_high")) & (F.col("close") < F.col("range_high")), "sweep_high").when(F.col("close") > F.col("range_high"), "break_up")
        .when(F.col("close") < F.col("range_low"), "break_down").when(F.col("close") < F.col("range_low") + 0.25 * (F.col("range_high") - F.col("range_low")), "near_low")
        .when(F.col("close") > F.col("range_high") - 0.25 * (F.col("range_high") - F.col("range_low")), "near_high").otherwise("middle")
    )
    return out.withColumns({"range_size": size, "place": place})


def funding_regime(samples: DataFrame, n: int = 21) -> DataFrame:
    """Percentile of each rate among its last ``n`` (share strictly below), mean, change over three samples, and the regime."""
    w = rows(-(n - 1))
    seen = F.collect_list("rate").over(w)
    out = samples.withColumns(
        {"share_below": F.size(F.filter(seen, lambda x: x < F.col("rate"))) / F.size(seen) * 100, "mean_rate": F.avg("rate").over(w), "velocity": F.col("rate") - F.lag("rate", 2).over(by_time())}
    )
    regime = F.when(F.col("share_below") >= 90, "extreme_long").when(F.col("share_below") <= 5, "extreme_short").when(F.col("mean_rate") > 0.0004, "elevated").otherwise("neutral")
    return out.withColumn("regime", regime)


def naked_levels(levels: DataFrame, days: DataFrame, tolerance: float) -> DataFrame:
    """For each day, levels of earlier days (symbol, day, level) that no day strictly between has come within ``tolerance`` of.

    A level dies once, so each is joined to the first day that touched it, and not to every day.
    """
    near = F.col("d.low") <= F.col("l.level") * (1 + tolerance)
    touch = levels.alias("l").join(days.alias("d"), (F.col("l.symbol") == F.col("d.symbol")) & (F.col("d.day") > F.col("l.day")) & near & (F.col("d.high") >= F.col("l.level") * (1 - tolerance)), "left")
    death = touch.groupBy("l.symbol", "l.day", "l.level").agg(F.min("d.day").alias("touched"))
    last = days.groupBy("symbol").agg(F.max("day").alias("last"))
    alive = death.join(last, "symbol").withColumn("until", F.coalesce("touched", "last"))
    return alive.select("symbol", "day", "level", "touched", (F.col("until") - F.col("day")).alias("days_naked"))


def untouched_rounds(bars: DataFrame, step: float, lookback: int = 20) -> DataFrame:
    """The round level next to each close, and whether the ``lookback`` bars before left it alone."""
    out = bars.withColumn("round", F.round(F.col("close") / step) * step)
    lows, highs = (F.collect_list(c).over(rows(-lookback, -1)) for c in ("low", "high"))
    touched = F.exists(F.arrays_zip(lows.alias("lo"), highs.alias("hi")), lambda b: (b["lo"] <= F.col("round")) & (b["hi"] >= F.col("round")))
    return out.withColumn("fresh", ~touched)


def structural_targets(price: Column, levels: Column, margin: float = 0.001) -> tuple[Column, Column]:
    """Nearest and furthest of the levels above the price by more than the margin."""
    beyond = F.filter(levels, lambda x: x > price * (1 + margin))
    return F.array_min(beyond), F.array_max(beyond)


def liquidation_density(swings: DataFrame, now_ms: int, half_life_ms: int) -> DataFrame:
    """Swing levels weighted by volume share and by age, halved each half-life, the heaviest first."""
    age = (F.lit(now_ms) - F.col("bucket")) / half_life_ms
    share = F.col("volume") / F.sum("volume").over(Window.partitionBy("symbol"))
    out = swings.withColumn("weight", share * F.exp(-F.log(F.lit(2.0)) * age))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("weight").desc(), "bucket")))


def candle_profile(bars: DataFrame, step: float) -> DataFrame:
    """Volume of each bar spread evenly over the bins that its range covers, by symbol and day."""
    low, high = F.floor(F.col("low") / step).cast("long"), F.floor(F.col("high") / step).cast("long")
    spread = bars.select("symbol", F.floor(F.col("bucket") / 86_400_000).cast("long").alias("day"), F.explode(F.sequence(low, high)).alias("bin"), (F.col("volume") / (high - low + 1)).alias("v"))
    return spread.groupBy("symbol", "day", "bin").agg(F.sum("v").alias("volume"))


def rebased(bars: DataFrame, from_ms: int) -> DataFrame:
    """Percent change of closes from the first close at or after ``from_ms``; a zero base gives null."""
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = bars.where(F.col("bucket") >= from_ms).withColumn("base", F.first("close").over(w))
    return seen.select("symbol", "bucket", (F.try_divide("close", "base") - 1).alias("change"))


def hysteresis(bars: DataFrame, value: str, enter: float, leave: float) -> DataFrame:
    """A state that starts beyond ``enter`` and lasts until inside ``leave`` or until the value changes sign: it depends on its own last value.

    Bars beyond ``enter``, inside ``leave`` or of another sign than the bar before decide; the bars between keep the state of the
    last of these, so the state is the last non-null decision, and needs no loop. (A held state has the sign of its bar.)
    """
    x = F.col(value)
    turned = F.signum(x) != F.signum(F.lag(x).over(by_time()))
    decided = F.when(x >= enter, 1).when(x <= -enter, -1).when((F.abs(x) <= leave) | turned, 0)
    return bars.withColumn("state", F.coalesce(F.last(decided, True).over(rows(Window.unboundedPreceding)), F.lit(0)))


def sticky_regime(bars: DataFrame) -> DataFrame:
    """``sticky``: the ``regime`` of each bar, but a trend lasts while its ``slow`` or its ``fast`` slope is past the exit bounds.

    Regimes that are no trend and no chop are taken as they are. One ordered pass over a symbol's bars.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        state, out = None, []
        for raw, slow, fast in zip(rows["regime"], rows["slow"], rows["fast"], strict=True):
            keeps = {"trend_up": slow > 0.05 or fast > 0.15, "trend_down": slow < -0.05 or fast < -0.15}.get(state, False)
            state = state if keeps and raw in ("trend_up", "trend_down", "chop") else raw
            out.append(state)
        return pd.DataFrame({"symbol": rows["symbol"], "bucket": rows["bucket"], "sticky": out})

    return bars.select("symbol", "bucket", "regime", "slow", "fast").groupBy("symbol").applyInPandas(run, "symbol string, bucket long, sticky string")


def large_trade_flow(trades: DataFrame, alpha: float = 0.02, factor: float = 4.0, seed: float = 5.0) -> DataFrame:
    """Signed volume of trades over ``factor`` times the running mean size that held when their hour began.

    The mean is an affine function of the mean before, so each (symbol, hour) sums to two numbers, what it keeps of the
    mean that it starts with and what it adds; one pass over a symbol's hours composes them, and hours then look up
    their limit. No task holds more than an hour of trades or the hours of a symbol.
    """
    t = trades.select("symbol", "ts_ms", "seq", "qty", "is_sell", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(3_600_000))).alias("bucket"))
    last = Window.partitionBy("symbol", "bucket").orderBy(F.col("ts_ms").desc(), F.col("seq").desc())
    aged = t.withColumn("_age", F.row_number().over(last) - 1)  # trades of the hour after it
    hours = aged.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(alpha * F.col("qty") * F.pow(F.lit(1 - alpha), F.col("_age"))).alias("adds"))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        mean, limits = seed, []
        for n, adds in zip(rows["n"], rows["adds"], strict=True):
            limits.append(mean * factor)
            mean = mean * (1 - alpha) ** n + adds
        return pd.DataFrame({"symbol": rows["symbol"], "bucket": rows["bucket"], "limit": limits})

    limits = hours.groupBy("symbol").applyInPandas(carry, "symbol string, bucket long, limit double")
    signed = F.when(F.col("qty") > F.col("limit"), F.when(F.col("is_sell"), -F.col("qty")).otherwise(F.col("qty"))).otherwise(0)
    return t.join(limits, ["symbol", "bucket"]).groupBy("symbol", "bucket").agg(F.sum(signed).alias("flow"))


def outcome_horizons(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Result in units of risk of long signals (symbol, n, entry, stop) at each horizon in bars, null beyond the series."""
    later = bars.select("symbol", F.col("n").alias("m"), "close")
    near = signals.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("m", F.col("n") + F.col("h"))
    r = F.try_divide(F.col("close") - F.col("entry"), F.col("entry") - F.col("stop"))
    return near.join(later, ["symbol", "m"], "left").groupBy("symbol", "n").pivot("h", list(horizons)).agg(F.first(r))
