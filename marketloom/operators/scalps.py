"""Short-lived setups on a sample of the book: expressions over a row, and states voted by weighted evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import region


@dataclass(frozen=True)
class MakerRules:
    """Fixed values; imbalances are shares of the bid side, 0.5 where the book is even."""

    spread_ticks: float = 2.0
    most_volume: float = 5.0
    least_volume: float = 1.5
    away: float = 0.05
    long_at: float = 0.60
    short_at: float = 0.40
    tick: float = 0.10
    cost: float = 0.00040
    reward: float = 1.5
    london_score: float = 70.0


def imbalance_maker(samples: DataFrame, rules: MakerRules | None = None) -> DataFrame:
    """Quotes where fast and slow imbalance lean to one side that flow and microprice share.

    Needs ``ts_ms, spread_ticks, vr, fast, slow, cvd, micro, close, atr``; adds ``side``, ``entry``, ``stop``, ``near``, ``far``, ``reward`` and ``score`` to rows that quote.
    """
    r = rules or MakerRules()
    fast, micro = F.col("fast"), F.col("micro")
    zone = region(F.col("ts_ms"))
    s = F.when((fast >= r.long_at) & (F.col("cvd") > 0), 1).when((fast <= r.short_at) & (F.col("cvd") < 0), -1)
    ok = zone.isin("london", "overlap", "new_york") & (F.col("spread_ticks") <= r.spread_ticks) & F.col("vr").between(r.least_volume, r.most_volume)
    ok = ok & (F.abs(fast - 0.5) >= r.away) & (F.abs(F.col("slow") - 0.5) >= r.away)
    on_tick = lambda price: F.round(price / r.tick) * r.tick
    half = 2.0 * F.greatest(F.greatest("atr", F.lit(10.0)) / 100.0, F.lit(1.0)) * r.tick
    out = samples.withColumn("_s", s).where(ok & F.col("_s").isNotNull() & ((micro - F.col("close")) * F.col("_s") > 0))
    out = out.withColumn("entry", on_tick(micro - F.col("_s") * half + 4.0 * (fast - 0.5) * r.tick))
    target = F.greatest(F.col("entry") * r.cost * 1.8, F.lit(6.0 * r.tick))
    out = out.withColumns({"stop": on_tick(F.col("entry") - F.col("_s") * target * 0.65), "near": on_tick(F.col("entry") + F.col("_s") * target), "far": on_tick(F.col("entry") + F.col("_s") * target * 1.5)})
    reward = F.abs(F.col("near") - F.col("entry")) / F.greatest(F.abs(F.col("entry") - F.col("stop")), F.lit(r.tick))
    score = F.least(F.greatest(F.abs(fast - 0.5) * 200.0, F.lit(55.0)), F.lit(95.0))
    out = out.withColumns({"reward": reward, "score": score}).where((F.col("reward") >= r.reward) & ((zone != "london") | (F.col("score") >= r.london_score)))
    return out.withColumn("side", F.when(F.col("_s") > 0, "long").otherwise("short")).drop("_s")


def voted(evidence: list[tuple[str, Column, int, str]], states: list[str], least: int) -> tuple[Column, Column, Column]:
    """State, points and reasons from rows of (state, test, points, reason): the most points, the last of ``states`` among equal ones, none under ``least``."""
    held = lambda test: F.coalesce(test, F.lit(False))
    points = {s: sum((F.when(held(t), p).otherwise(0) for name, t, p, _ in evidence if name == s), F.lit(0)) for s in states}
    best = F.array_max(F.array(*[F.struct(points[s].alias("points"), F.lit(k).alias("k")) for k, s in enumerate(states)]))
    state = F.element_at(F.array(*[F.lit(s) for s in states]), (best["k"] + 1).cast("int"))
    reasons = F.array_compact(F.array(*[F.when(held(t) & (best["k"] == states.index(s)), F.lit(why)) for s, t, _, why in evidence]))
    known = best["points"] >= least
    return F.when(known, state).otherwise("unknown"), F.when(known, F.least(best["points"], F.lit(100))).otherwise(0), F.when(known, reasons).otherwise(F.array().cast("array<string>"))


#: Tests of an auction's state, and the points that each speaks with for each state (fixed values).
TESTS = {
    "above_value": "close > value_high", "below_value": "close < value_low", "in_value": "close BETWEEN value_low AND value_high", "near_top": "close >= value_low", "near_bottom": "close <= value_high",
    "cvd_up": "slope > 0.05", "cvd_down": "slope < -0.05", "cvd_flat": "NOT coalesce(abs(slope) > 0.05, false)", "delta_up": "delta > 0", "delta_down": "delta < 0", "delta_flat": "coalesce(delta, 0) = 0",
    "taker_up": "taker > 0.10", "taker_down": "taker < -0.10", "oi_expands": "oi_aligned", "bearish_divergence": "divergence >= 3", "bullish_divergence": "divergence <= -3", "calm": "coalesce(vpin_share < 0.70, true)",
}
POINTS = {
    "up_imbalance": {"above_value": 30, "cvd_up": 20, "delta_up": 15, "taker_up": 15, "oi_expands": 20},
    "down_imbalance": {"below_value": 30, "cvd_down": 20, "delta_down": 15, "taker_down": 15, "oi_expands": 20},
    "distribution": {"near_top": 10, "bearish_divergence": 50, "cvd_down": 20, "delta_down": 20},
    "accumulation": {"near_bottom": 10, "bullish_divergence": 50, "cvd_up": 20, "delta_up": 20},
    "balance": {"in_value": 30, "calm": 20, "cvd_flat": 25, "delta_flat": 25},
}


def auction_state(bars: DataFrame) -> DataFrame:
    """``state``, ``confidence`` and ``reasons`` from ``close, value_low, value_high, slope, delta, taker, oi_aligned, divergence, vpin_share``, any of them null."""
    evidence = [(state, F.expr(TESTS[test]), points, test) for state, rows in POINTS.items() for test, points in rows.items()]
    state, confidence, reasons = voted(evidence, list(POINTS), 30)
    return bars.withColumns({"state": state, "confidence": confidence.cast("int"), "reasons": reasons})


@dataclass(frozen=True)
class FadeRules:
    """Fixed values of the two fades."""

    spread_ticks: float = 2.0
    most_volume: float = 5.0
    delta_z: float = 1.5
    least_volume: float = 2.0
    score: float = 55.0
    reward: float = 1.5
    tick: float = 0.10
    flow_bars: int = 20
    lookback: int = 20
    strength: float = 0.30
    fresh: int = 5
    history: int = 100


def ramped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def turns_of(flows: Column, s: Column, least: int = 4) -> Column:
    """Steps of a series that go to the side ``s``, 0 for a short one."""
    steps = F.zip_with(F.slice(flows, 2, 1_000), flows, lambda b, a: F.when((b - a) * s > 0, 1).otherwise(0))
    return F.when(F.size(flows) >= least, F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)).otherwise(0)


def absorption_fade(bars: DataFrame, rules: FadeRules | None = None) -> DataFrame:
    """Fades at the edge of a range where aggression meets a bar that closes against it.

    Needs ``bucket, open, high, low, close, dz, vr, atr, spread_ticks, regime, range_high, range_low, cvd`` and, null if unknown, ``candle_poc, poc, big_sell, big_buy, liq_ratio``.
    """
    from .indicators import rows

    r = rules or FadeRules()
    c = F.col
    at = F.coalesce(F.try_divide(c("close") - c("range_low"), c("range_high") - c("range_low")), F.lit(0.5))
    out = bars.withColumns({"_flows": F.collect_list("cvd").over(rows(1 - r.flow_bars)), "_s": F.when(at < 0.35, 1).when(at > 0.65, -1)})
    s, atr = c("_s"), F.greatest("atr", F.lit(10.0))
    inside = F.when(s > 0, c("close") >= c("range_low")).otherwise(c("close") <= c("range_high"))
    out = out.where((c("regime") == "range") & (region(c("bucket")) != "off_hours") & c("range_high").isNotNull() & (c("spread_ticks") <= r.spread_ticks) & c("vr").between(r.least_volume, r.most_volume))
    out = out.where(s.isNotNull() & (c("dz") * s <= -r.delta_z) & inside & ((c("close") - c("open")) * s > 0))
    span = F.greatest(c("high") - c("low"), F.lit(1e-9))
    wick = F.when(s > 0, c("candle_poc") - c("low")).otherwise(c("high") - c("candle_poc")) / span
    far = F.abs(c("close") - F.when(s > 0, c("range_low")).otherwise(c("range_high"))) / F.greatest("atr", F.lit(1e-9))
    trapped = F.coalesce(F.when(s > 0, c("big_sell")).otherwise(c("big_buy")), F.lit(False))
    parts = [
        22.0 * ramped(F.greatest(-c("dz") * s, F.lit(0.0)), 1.5, 3.0), 12.0 * ramped(F.abs("dz"), 1.5, 2.5), 10.0 * ramped(c("vr"), 2.0, 4.0), 12.0 * F.coalesce(F.greatest(0.35 - wick, F.lit(0.0)) / 0.35, F.lit(0.0)),
        18.0 * F.greatest(0.25 - far, F.lit(0.0)) / 0.25, 8.0 * ramped(turns_of(c("_flows"), s).cast("double"), 1.0, 3.0), F.when(trapped, 6.0).otherwise(0.0), 6.0 * ramped(F.coalesce("liq_ratio", F.lit(0.0)), 3.0, 8.0),
    ]
    out = out.withColumn("score", sum(parts[1:], parts[0]))
    stop = F.when(s > 0, F.least(c("low") - 0.25 * atr, c("range_low") - 3.0 * r.tick)).otherwise(F.greatest(c("high") + 0.25 * atr, c("range_high") + 3.0 * r.tick))
    middle = c("range_low") + (c("range_high") - c("range_low")) * 0.5
    out = out.withColumns({"entry": c("close") + s * r.tick, "stop": stop, "near": F.coalesce("poc", middle), "far": F.when(s > 0, c("range_high")).otherwise(c("range_low"))})
    out = out.withColumn("reward", F.abs(c("near") - c("entry")) / F.greatest(F.abs(c("entry") - c("stop")), F.lit(r.tick)))
    out = out.where((c("score") >= r.score) & (c("reward") >= r.reward))
    return out.withColumns({"side": F.when(s > 0, "long").otherwise("short"), "hurry": (F.abs("dz") > 2.5) & (c("vr") > 3.0)}).drop("_s", "_flows")


def last_swings(window: Column, price: str, n: int, s: int) -> Column:
    """Of a window of ``n`` (price, cvd) structs the last two places of strict-or-equal extremes of side ``s``, with two bars before and one after."""
    at = lambda i: F.get(window, i)[price] * s
    places = F.filter(F.sequence(F.lit(2), F.lit(n - 2)), lambda i: (at(i) >= at(i - 1)) & (at(i) >= at(i - 2)) & (at(i) >= at(i + 1)))
    return F.when(F.size(places) >= 2, F.struct(F.try_element_at(places, F.lit(-2)).alias("before"), F.try_element_at(places, F.lit(-1)).alias("last")))


def divergence_fade(bars: DataFrame, rules: FadeRules | None = None) -> DataFrame:
    """Fades of a new swing extreme that the flow did not confirm: price of the last swing at or beyond the one before, cumulative delta short of it.

    Needs ``bucket, high, low, close, cvd, dz, vr, atr, spread_ticks, obi_fast`` (a share of the bid side) and, null if unknown, ``poc``.
    """
    from .indicators import rows

    r = rules or FadeRules()
    c, n = F.col, r.lookback
    out = bars.withColumns({"_w": F.collect_list(F.struct("high", "low", "cvd")).over(rows(1 - n)), "_past": F.collect_list(F.struct("high", "low")).over(rows(1 - r.history, -1))})
    mean = F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.abs(x["cvd"].cast("double"))) / n
    for name, price, s in (("_top", "high", 1), ("_bottom", "low", -1)):
        w, p = c("_w"), last_swings(c("_w"), price, n, s)
        last, before = F.get(w, p["last"]), F.get(w, p["before"])
        gap = (before["cvd"] - last["cvd"]) * s / mean
        fits = (last[price] * s >= before[price] * s) & (gap > 0) & (gap >= r.strength)
        out = out.withColumn(name, F.when((F.size("_w") == n) & (mean >= 1e-9) & fits, F.struct(last[price].cast("double").alias("price"), gap.alias("strength"), (n - 1 - p["last"]).alias("ago"))))
    top = c("_top").isNotNull() & (c("_bottom").isNull() | (c("_top.strength") >= c("_bottom.strength")))
    out = out.withColumns({"_s": F.when(top, -1).when(c("_bottom").isNotNull(), 1), "_d": F.when(top, c("_top")).otherwise(c("_bottom"))})
    s, atr = c("_s"), F.greatest("atr", F.lit(10.0))
    out = out.where(s.isNotNull() & (c("_d.ago") <= r.fresh) & (region(c("bucket")) != "off_hours") & (c("spread_ticks") <= r.spread_ticks) & (c("vr") <= r.most_volume) & ((c("obi_fast") - 0.5) * s > -0.02) & (c("dz") * s > -0.5))
    beyond = F.filter(F.transform("_past", lambda x: F.when(s > 0, x["high"]).otherwise(x["low"])), lambda x: x * s > c("close") * s)
    swing = F.coalesce(F.try_element_at(beyond, F.lit(-1)), c("close") + s * atr * 0.8)
    other = F.coalesce("poc", c("close") + s * atr * 1.5)
    aim = F.when(s > 0, F.greatest(swing, other)).otherwise(F.least(swing, other))
    out = out.withColumns({"entry": c("close") + s * r.tick, "stop": c("_d.price") - s * atr * 0.3, "near": aim, "far": aim, "strength": c("_d.strength"), "bars_ago": c("_d.ago")})
    out = out.withColumn("reward", F.abs(c("near") - c("entry")) / F.greatest(F.abs(c("entry") - c("stop")), F.lit(r.tick))).where(c("reward") >= r.reward)
    return out.withColumns({"side": F.when(s > 0, "long").otherwise("short"), "score": F.least(F.greatest(c("strength") * 30.0, F.lit(55.0)), F.lit(95.0))}).drop("_w", "_past", "_top", "_bottom", "_s", "_d")
