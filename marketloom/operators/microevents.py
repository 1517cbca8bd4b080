"""Events of the microstructure on a panel of seconds: sixteen kinds in one pass, each at rest after it, with what came next.

A (symbol, day) is the widest window: a panel has 86,400 rows a day at most, and days are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY
from .structure import cooldown


@dataclass(frozen=True)
class Rules:
    """Lengths in rows of the panel."""

    base: int = 1800
    least: int = 120
    burst: int = 10
    extreme: int = 900
    rest: int = 60
    after: tuple[int, int, int] = (60, 300, 900)


#: Kinds with the side that they are expected to lead to (fixed values).
KINDS = {
    "big_trade_buy": 1, "big_trade_sell": -1, "delta_burst_pos": 1, "delta_burst_neg": -1, "vol_spike": 0, "absorb_ask": -1, "absorb_bid": 1, "sweep_up": -1, "sweep_down": 1,
    "obi_extreme_pos": 1, "obi_extreme_neg": -1, "obi_flip_up": 1, "obi_flip_down": -1, "spread_spike": 0, "micro_div_up": 1, "micro_div_down": -1,
}


def second_panel(seconds: DataFrame, trades: DataFrame) -> DataFrame:
    """Book samples by ``second`` (``depth.book_seconds``) with the trades of their second."""
    signed = F.when(F.col("is_sell"), -F.col("qty")).otherwise(F.col("qty"))
    flow = trades.groupBy("symbol", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(1000))).alias("second")).agg(F.sum("qty").alias("vol"), F.sum(signed).alias("delta"), F.max("qty").alias("max_trade"), F.count(F.lit(1)).alias("n_trades"))
    return seconds.join(flow, ["symbol", "second"], "left").na.fill(0, ["vol", "delta", "max_trade", "n_trades"])


def micro_events(panel: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``symbol, ts_ms, event, hint`` with the returns after it in basis points, and the best and worst of them, from a panel of seconds."""
    r = rules or Rules()
    by = Window.partitionBy("symbol", "_day").orderBy("second")
    span = lambda first, last=0: by.rowsBetween(first, last)
    enough = F.count(F.lit(1)).over(span(1 - r.base)) >= r.least

    def mean(c: str) -> Column:
        return F.when(enough, F.avg(c).over(span(1 - r.base)))

    def spread(c: str) -> Column:
        return F.when(enough, F.stddev_samp(c).over(span(1 - r.base)))

    burst = lambda c: F.sum(c).over(span(1 - r.burst))
    p = panel.withColumn("_day", F.floor(F.col("second") / DAY))
    p = p.withColumns(
        {
            "_n": F.row_number().over(by), "_d": burst("delta"), "_v": burst("vol"), "_vm": mean("vol"), "_vs": spread("vol") + 1e-9, "_big": F.col("max_trade") >= mean("max_trade") + 3 * (spread("max_trade") + 1e-9),
            "_ds": spread("delta") * F.sqrt(F.lit(float(r.burst))) + 1e-9, "_move": (F.col("mid") - F.lag("mid", r.burst).over(by)) / F.col("mid"), "_wide": F.col("spread_bps") >= mean("spread_bps") + 5 * (spread("spread_bps") + 1e-9),
            "_top": F.max("mid").over(span(-r.extreme, -1)), "_bottom": F.min("mid").over(span(-r.extreme, -1)), "_obi": F.lag("obi10", r.burst).over(by),
            "_lean": (F.col("micro") - F.col("mid")) * 1e4 / (F.col("spread_bps") * F.col("mid") + 1e-9),
            **{f"_f{k}": (F.lead("mid", h).over(by) / F.col("mid") - 1) * 1e4 for k, h in enumerate(r.after)},
            "_best": (F.max("mid").over(span(0, r.after[2] - 1)) / F.col("mid") - 1) * 1e4, "_worst": (F.min("mid").over(span(0, r.after[2] - 1)) / F.col("mid") - 1) * 1e4,
        }
    )
    c = F.col
    spike = c("_v") >= r.burst * (c("_vm") + 3 * c("_vs"))
    heavy = (c("_v") >= r.burst * (c("_vm") + c("_vs"))) & (F.abs(c("_move")) < 0.0002)
    when = {
        "big_trade_buy": c("_big") & (c("delta") > 0), "big_trade_sell": c("_big") & (c("delta") < 0), "delta_burst_pos": c("_d") >= 3 * c("_ds"), "delta_burst_neg": c("_d") <= -3 * c("_ds"), "vol_spike": spike,
        "absorb_ask": heavy & (c("_d") > 0), "absorb_bid": heavy & (c("_d") < 0), "sweep_up": (c("mid") > c("_top")) & spike, "sweep_down": (c("mid") < c("_bottom")) & spike,
        "obi_extreme_pos": c("obi10") >= 0.8, "obi_extreme_neg": c("obi10") <= -0.8, "obi_flip_up": (c("_obi") < -0.5) & (c("obi10") > 0.5), "obi_flip_down": (c("_obi") > 0.5) & (c("obi10") < -0.5),
        "spread_spike": c("_wide"), "micro_div_up": c("_lean") > 0.25, "micro_div_down": c("_lean") < -0.25,
    }
    kinds = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("event"), F.lit(KINDS[kind]).alias("hint"))) for kind, test in when.items()]))
    found = p.where(c("_f2").isNotNull()).select(
        "symbol", "ts_ms", "_day", "_n", F.explode(kinds).alias("e"), c("_f0").alias("after_1"), c("_f1").alias("after_2"), c("_f2").alias("after_3"), c("_best").alias("best"), c("_worst").alias("worst")
    ).select("*", "e.*").drop("e")
    # a kind of a symbol and day rests on its own
    found = found.withColumn("_key", F.concat_ws("|", "symbol", "_day", "event"))
    return cooldown(found, "_key", "_n", r.rest, 8192).drop("_key", "_day", "_n")


#: Kinds from the most to the least telling, where one event a moment is wanted.
PRIORITY = ("sweep_up", "sweep_down", "absorb_ask", "absorb_bid", "big_trade_buy", "big_trade_sell", "delta_burst_pos", "delta_burst_neg", "obi_flip_up", "obi_flip_down", "vol_spike", "spread_spike", "micro_div_up", "micro_div_down", "obi_extreme_pos", "obi_extreme_neg")


def resolved(events: DataFrame, within_ms: int, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """One event for each island of events of a symbol that follow each other within ``within_ms``: the first in ``priority``, the earliest of equal ones."""
    by = Window.partitionBy("symbol", F.floor(F.col("ts_ms") / DAY)).orderBy("ts_ms", "event")
    gap = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(by) > within_ms).cast("int"), F.lit(1))
    island = F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.array_position(F.array(*[F.lit(k) for k in priority]), F.col("event"))
    parted = events.withColumn("_gap", gap).withColumn("_island", island)
    best = Window.partitionBy("symbol", F.floor(F.col("ts_ms") / DAY), "_island").orderBy(rank, "ts_ms")
    many = F.count(F.lit(1)).over(Window.partitionBy("symbol", F.floor(F.col("ts_ms") / DAY), "_island"))
    return parted.withColumns({"_nth": F.row_number().over(best), "of_island": many}).where("_nth = 1").drop("_gap", "_island", "_nth")
