"""Limit levels of each bar: where an order would wait, its stop and its targets.

Everything is an expression over bounded windows of a symbol's bars; candidates of a bar are rows, filtered and ranked within it.
``inverse_gaps`` chains first events: a gap, the first close through it, and the bars that come back to it afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY
from .indicators import by_time, rows
from .rolling_profile import value_areas
from .scan import affine_scan


@dataclass(frozen=True)
class Rules:
    """Lengths in bars, tolerances as shares of the price, the rest in units of the ATR or of risk."""

    least: int = 300
    area: int = 96
    step: float = 10.0
    swing: int = 50
    block: int = 15
    hour: int = 4
    away: float = 0.5
    stop_scale: float = 0.8
    touch: float = 0.002
    gap_bars: int = 60
    gap_touch: float = 0.0015
    gap_least: float = 0.15
    entry_touch: float = 0.001
    level_stop: float = 0.5
    level_bars: int = 20
    stop_floor: float = 0.0015
    reward: float = 1.2
    range_pct: float = 0.5
    cap: float = 0.0
    expansion: float = 1.30
    rounds: tuple[float, ...] = ()
    experimental: bool = True
    high_only: bool = False


def trending(atr: Column, atr_mean: Column, expansion: float, n: int = 5, warm: int = 60, band: float = 0.002) -> Column:
    """Ranges expand, or the last two closes lie on one side of a short EMA (seeded ``warm`` bars ago) by more than ``band``."""
    k = 2.0 / (n + 1.0)
    closes = F.collect_list("close").over(rows(-(warm - 1)))
    first = F.get(closes, F.lit(0))
    start = F.struct(first.alias("now"), F.lit(None).cast("double").alias("before"))
    ema = F.aggregate(closes, start, lambda s, x: F.struct((x * k + s["now"] * (1 - k)).alias("now"), s["now"].alias("before")))
    last = F.lag("close").over(by_time())
    up = (F.col("close") > ema["now"] * (1 + band)) & (last > ema["before"] * (1 + band))
    down = (F.col("close") < ema["now"] * (1 - band)) & (last < ema["before"] * (1 - band))
    expands = F.coalesce((atr_mean > 0) & (atr / atr_mean > expansion), F.lit(False))
    return (F.count(F.lit(1)).over(rows(-24)) == 25) & (expands | F.coalesce(up | down, F.lit(False)))


def inverse_gaps(bars: DataFrame, n: int) -> DataFrame:
    """``filled_up`` and ``filled_down``: of each bar the gaps of the ``n`` bars before it that a close has gone through since, oldest first.

    A gap up at bar ``at`` lies between the high two bars before and the low of ``at``; it turns when a later close falls below its bottom, at
    ``turned``. Each gap looks up its own first turn among the next ``n`` bars; a bar then reads the gaps of its window that turned before it.
    """
    two = {c: F.lag(c, 2).over(by_time()) for c in ("high", "low")}
    later = F.collect_list(F.struct("n", "close")).over(rows(1, n))
    first = lambda hit: F.get(F.filter(later, hit), F.lit(0))["n"]
    out = bars.withColumns({"_h2": two["high"], "_l2": two["low"]})
    out = out.withColumns({"_up": first(lambda x: x["close"] < F.col("_h2")), "_down": first(lambda x: x["close"] > F.col("_l2"))})
    gap = lambda bottom, top, turned: F.when((top > bottom) & turned.isNotNull(), F.struct(F.col("n").alias("at"), bottom.alias("bottom"), top.alias("top"), turned.alias("turned")))
    out = out.withColumns({"_up": gap(F.col("_h2"), F.col("low"), F.col("_up")), "_down": gap(F.col("high"), F.col("_l2"), F.col("_down"))})
    seen = rows(-(n - 1), -2)
    known = lambda c: F.filter(F.collect_list(c).over(seen), lambda g: g["turned"] < F.col("n"))
    return out.withColumns({"filled_up": known("_up"), "filled_down": known("_down")}).drop("_h2", "_l2", "_up", "_down")


def structure(bars: DataFrame, r: Rules) -> DataFrame:
    """What levels are drawn from: value area, swings, extremes of the day before and of the eight days before."""
    day = F.floor(F.col("bucket") / DAY).cast("long")
    days = bars.groupBy("symbol", day.alias("_day")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
    week = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-8, -1)
    yesterday = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-1, -1)
    days = days.select("symbol", "_day", F.max("h").over(week).alias("week_high"), F.min("l").over(week).alias("week_low"), F.max("h").over(yesterday).alias("day_high"), F.min("l").over(yesterday).alias("day_low"))
    out = value_areas(bars, r.area, r.step).withColumn("_day", day).join(days, ["symbol", "_day"]).drop("_day")
    recent = F.collect_list(F.struct("low", "high")).over(rows(-(r.block - 1)))
    near = lambda side: F.size(F.filter(F.col("_recent"), lambda b: F.abs(b[side] - F.col("va_poc")) / F.col("va_poc") <= r.touch))
    block = F.max_by(F.struct("high", "low", "poc"), F.struct(F.col("high") - F.col("low"), F.col("n"))).over(rows(-(r.block - 1)))
    out = out.withColumns({"swing_high": F.max("high").over(rows(-r.swing, -1)), "swing_low": F.min("low").over(rows(-r.swing, -1)), "_recent": recent, "_block": block, "_hour": F.coalesce(F.lag("close", r.hour).over(by_time()), F.col("close"))})
    return out.withColumns({"_touched_low": near("low"), "_touched_high": near("high")})


def targets(s: int, entry: Column) -> Column:
    """Nearest and furthest structure beyond an entry of side ``s`` by a thousandth; the nearest only if it is another, null if there is none."""
    names = ("va_high", "swing_high", "day_high", "week_high") if s > 0 else ("va_low", "swing_low", "day_low", "week_low")
    found = F.filter(F.array(*names), lambda x: x > entry * 1.001 if s > 0 else x < entry * 0.999)
    near, far = (F.array_min(found), F.array_max(found)) if s > 0 else (F.array_max(found), F.array_min(found))
    return F.when(F.size(found) > 0, F.struct(F.when(F.abs(near - far) >= 1.0, near).alias("near"), far.alias("far")))


def candidate(kind: str, s: int, entry: Column, stop: Column, when: Column, least_reward: float | None = None) -> Column:
    aim = targets(s, entry)
    ok = F.coalesce(when, F.lit(False)) & aim.isNotNull()
    if least_reward is not None:
        ok = ok & ((aim["far"] - entry) * s / ((entry - stop) * s) >= least_reward)
    made = F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("s"), entry.alias("price"), stop.alias("stop"), aim["near"].alias("near"), aim["far"].alias("far"))
    return F.when(ok, made)


def turned_gap(kind: str, s: int, r: Rules) -> Column:
    """The oldest gap that turned and that this bar tests: from below its bottom (``s`` -1), or from above its top."""
    edge, other = ("bottom", "top") if s < 0 else ("top", "bottom")

    def tests(g: Column) -> Column:
        back = F.col("high") >= g[edge] * (1 - r.gap_touch) if s < 0 else F.col("low") <= g[edge] * (1 + r.gap_touch)
        return (g["top"] - g["bottom"] >= r.gap_least * F.col("atr")) & back & ((F.col("close") - g[edge]) * s > 0) & targets(s, g[edge]).isNotNull()

    g = F.get(F.filter("filled_up" if s < 0 else "filled_down", tests), F.lit(0))
    slope = (F.col("close") - F.col("_hour")) * s > 0
    return candidate(kind, s, g[edge], g[other] - s * 0.25 * F.col("atr"), g.isNotNull() & slope & (F.abs(F.col("close") - g[edge]) >= r.away * F.col("atr")))


def limit_levels(bars: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Levels of each bar from ``symbol, bucket, n, high, low, close, volume, poc, atr, atr_median, atr_mean``, in order of rank.

    ``poc`` is a bar's own point of control (its middle where it has no footprint). Of levels of a side within two units of the price the first stays.
    """
    r = rules or Rules()
    price, atr = F.col("close"), F.col("atr")
    b = structure(bars, r).withColumns({"trend": trending(atr, F.col("atr_mean"), r.expansion), "wide": F.coalesce((F.col("atr_median") > 0) & (atr > F.col("atr_median")), F.lit(False))})
    b = inverse_gaps(b, r.gap_bars)
    clean = lambda level: F.abs(price - level) >= r.away * atr
    up, down = price > F.col("_hour"), price < F.col("_hour")
    block, va = F.col("_block"), F.col("va_poc")
    found = [
        candidate("poc_ob", 1, block["poc"], block["low"] - 0.25 * r.stop_scale * atr, up & clean(block["poc"])),
        candidate("poc_ob", -1, block["poc"], block["high"] + 0.25 * r.stop_scale * atr, down & clean(block["poc"])),
        candidate("poc_def", 1, va, va - 0.6 * r.stop_scale * atr, (F.col("_touched_low") >= 2) & up & clean(va)),
        candidate("poc_def_short", -1, va, va + 0.6 * r.stop_scale * atr, (F.col("_touched_high") >= 2) & down & clean(va)),
    ]
    if r.experimental:
        low, high = F.col("week_low") * (1 + r.entry_touch), F.col("week_high") * (1 - r.entry_touch)
        found += [
            turned_gap("ifvg_bear", -1, r),
            turned_gap("ifvg_bull", 1, r),
            candidate("weekly_l", 1, low, low - r.level_stop * atr, (F.col("week_low") > 0) & (F.col("low") <= low) & (price > F.col("week_low")), r.reward),
            candidate("weekly_h", -1, high, high + r.level_stop * atr, (F.col("week_high") > 0) & (F.col("high") >= high) & (price < F.col("week_high")), r.reward),
        ]
        before = F.collect_list(F.struct("low", "high")).over(rows(-r.level_bars, -1))
        b = b.withColumn("_before", before)
        touched = lambda at: F.exists("_before", lambda x: (F.abs(x["low"] - at) / at <= r.touch) | (F.abs(x["high"] - at) / at <= r.touch))
        for step in r.rounds:
            at = F.round(price / step) * step
            virgin = (at > 0) & ~touched(at)
            found += [
                candidate("round_l", 1, at, at - r.level_stop * atr, virgin & (price > at) & (F.col("low") <= at * (1 + r.touch)), r.reward),
                candidate("round_h", -1, at, at + r.level_stop * atr, virgin & (price < at) & (F.col("high") >= at * (1 - r.touch)), r.reward),
            ]
    ready = (F.col("n") >= r.least) & (atr > 0)
    if r.high_only:
        ready = ready & F.col("wide")
    each = b.where(ready).select("symbol", "bucket", "close", "trend", "wide", F.posexplode(F.array(*found)).alias("rank", "c")).where("c IS NOT NULL").select("symbol", "bucket", "close", "trend", "wide", "rank", "c.*")
    return ranked(each, r)


def ranked(each: DataFrame, r: Rules) -> DataFrame:
    """Stops at least the floor away, targets capped, those without enough reward or on the wrong side dropped; the first of near equals stays."""
    s, price = F.col("s"), F.col("price")
    floor = price * r.stop_floor
    each = each.withColumn("stop", F.when(F.abs(price - F.col("stop")) < floor, price - s * floor).otherwise(F.col("stop")))
    each = each.withColumn("risk", F.abs(price - F.col("stop"))).where("risk > 0")
    if r.cap > 0:
        cap = price + s * r.cap * F.col("risk")
        beyond = (F.col("far") - cap) * s > 0
        inside = ((F.col("near") - price) * s > 0) & ((cap - F.col("near")) * s > 0)
        each = each.withColumns({"near": F.when(~beyond | inside, F.col("near")), "far": F.when(beyond, cap).otherwise(F.col("far"))})
    each = each.where(F.abs(F.col("far") - price) / F.col("risk") >= r.reward)
    each = each.where(((F.col("close") - price) * s > 0) & ((price - F.col("stop")) * s > 0) & ((F.col("far") - price) * s > 0))
    crumbs = ~F.col("trend") & F.col("near").isNotNull() & (F.abs(F.col("near") - price) / price * 100.0 < r.range_pct)
    first = Window.partitionBy("symbol", "bucket", "s", F.round(price / 2.0)).orderBy("rank")
    each = each.where(~crumbs).withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return each.select(
        "symbol", "bucket", "rank", "kind", F.when(s > 0, "long").otherwise("short").alias("side"), "price", "stop", "near", "far", F.col("near").isNotNull().alias("take_partial"),
        F.when(F.col("trend"), "trail").otherwise("fade").alias("manage"), F.when(F.col("trend"), "trend").otherwise("chop").alias("regime"), F.when(F.col("wide"), "high").otherwise("low").alias("volatility"),
    )


def frame_stop(bars: DataFrame, frame_ms: int, factor: float, n: int = 14, part: int = 32 * DAY) -> DataFrame:
    """``stop`` of a short: the high so far of the bar's wider frame and ``factor`` of the Wilder range of the frames before it, and its distance in percent.

    The range of a frame is known when it ends, so a bar sees that of the frame before; the first frame of a symbol has none.
    """
    frame = (F.col("bucket") - F.pmod("bucket", F.lit(frame_ms))).alias("_frame")
    frames = bars.groupBy("symbol", frame).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bucket").alias("c"))
    before = F.lag("c").over(Window.partitionBy("symbol").orderBy("_frame"))
    frames = frames.withColumn("tr", F.coalesce(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)), F.col("h") - F.col("l")))
    ranges = affine_scan(frames.select("symbol", "_frame", "tr"), "symbol", ["_frame"], F.lit((n - 1) / n), F.col("tr") / n, "atr", F.col("tr"), part)
    known = ranges.select("symbol", "_frame", F.lag("atr").over(Window.partitionBy("symbol").orderBy("_frame")).alias("frame_atr"))
    top = F.max("high").over(Window.partitionBy("symbol", "_frame").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("_frame", F.col("bucket") - F.pmod("bucket", F.lit(frame_ms))).join(known, ["symbol", "_frame"], "left")
    out = out.withColumn("stop", top + factor * F.col("frame_atr"))
    return out.withColumn("stop_pct", (F.col("stop") - F.col("close")) / F.col("close") * 100).drop("_frame")
