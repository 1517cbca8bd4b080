"""Detectors that read order book, positions and structure: predicates on one row a bar and side.

``sided`` makes two rows of each bar. The short one is the long one mirrored: prices and flow change sign, and what lies
above changes places with what lies below. So each rule is stated once, for a long. Missing inputs fail a rule unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that change sign, and pairs that change places as well (long name, short name).
FLOW = ("obi", "prev_obi", "taker", "slope", "fast", "delta", "funding", "basis")
#: Shares of accounts that are long, which become shares that are short.
SHARES = ("top", "retail")
PRICES = ("close", "vwap", "poc", "micro", "lvn")
SWAPPED = (("value_high", "value_low"), ("swing_high", "swing_low"), ("block_high", "block_low"))
FLAGS = (("thin_above", "thin_below"), ("wall_above", "wall_below"), ("liq_shorts", "liq_longs"))
MOST_SPREAD, LEAST_REWARD = 3.0, 1.0


def sided(market: DataFrame) -> DataFrame:
    both = market.withColumn("s", F.explode(F.array(F.lit(1), F.lit(-1))))
    s = F.col("s")
    turn = lambda up, down: F.when(s == 1, F.col(up)).otherwise(F.col(down))
    made = {c: s * F.col(c) for c in (*FLOW, *PRICES)}
    made |= {name: s * turn(name, other) for pair in SWAPPED for name, other in (pair, pair[::-1])}
    made |= {name: turn(name, other) for pair in FLAGS for name, other in (pair, pair[::-1])}
    made |= {c: F.when(s == 1, F.col(c)).otherwise(1 - F.col(c)) for c in SHARES}
    made |= {c: F.transform(c, lambda x: s * x) for c in ("nodes", "walls")}
    made["levels"] = F.transform("levels", lambda x: F.struct((s * x["price"]).alias("price"), (s * x["delta"]).alias("delta")))
    made["against"] = F.when(s == 1, F.lit("trend_down")).otherwise("trend_up")
    made["funding_ok"] = F.coalesce(F.when(s == 1, F.col("funding") < 0.0008).otherwise(F.col("funding") > -0.0005), F.lit(True))
    return both.withColumns(made)


def beyond(levels: Column, price: Column) -> Column:
    """The nearest level above."""
    return F.array_min(F.filter(levels, lambda x: x > price))


def calm() -> Column:
    return F.coalesce(F.col("spread") <= MOST_SPREAD, F.lit(True))


def basis_fits() -> Column:
    return F.coalesce(F.col("basis") <= 0.5, F.lit(True))


def setup(name: str, when: Column, stop: Column, target: Column, least_reward: float | None = LEAST_REWARD) -> Column:
    """Entry at the close, where the stop lies below, the target above, and the reward is enough."""
    px = F.col("close")
    ok = when & (stop < px) & (target > px)
    if least_reward is not None:
        ok = ok & ((target - px) / (px - stop) >= least_reward)
    found = F.struct(F.lit(name).alias("detector"), (F.col("s") * px).alias("entry"), (F.col("s") * stop).alias("stop"), (F.col("s") * target).alias("target"))
    return F.when(F.coalesce(ok, F.lit(False)), found)


def vacuum_breakout(cap: float = 2.0) -> Column:
    """Thin book and a low-volume node ahead, above VWAP, flow on its side, no wall in the way."""
    px, atr = F.col("close"), F.col("atr")
    near = F.abs(F.col("lvn") - px) <= atr
    flow = (F.col("delta") > 0) & (F.col("slope") > 0) & (F.abs("taker") < 0.90) & (F.col("micro") >= px)
    when = F.col("thin_above") & near & (px >= F.col("vwap")) & (px >= F.col("value_low")) & flow & calm() & ~F.col("wall_above") & basis_fits() & F.col("funding_ok")
    ahead = F.concat(F.col("nodes"), F.array("value_high", "swing_high"))
    return setup("vacuum_breakout", when, F.greatest(F.least(F.col("vwap"), px - 0.75 * atr), px - cap * atr), beyond(ahead, px))


def book_breakout(least: float = 0.2, least_slope: float = 0.0, most_counter: float = 0.5) -> Column:
    """Book imbalance that holds over two samples, into a thin book, from the nearest wall to the nearest node."""
    px = F.col("close")
    near = F.abs(F.col("lvn") - px) <= F.col("atr")
    when = (F.col("obi") > least) & (F.col("prev_obi") > 0.10) & F.col("thin_above") & near & (px > F.col("vwap")) & (F.col("slope") > least_slope)
    when = when & (F.col("fast") > -most_counter) & calm() & basis_fits()
    return setup("book_breakout", when, F.array_max(F.filter("walls", lambda w: w < px)), beyond(F.col("nodes"), px))


def block_retest() -> Column:
    """Price back in an order block that absorbs."""
    px = F.col("close")
    inside = (px >= F.col("block_low")) & (px <= F.col("block_high"))
    quiet = ~F.col("regime").isin("stress", "aftermath") & (F.col("regime") != F.col("against"))
    when = inside & F.col("absorbed") & (F.col("slope") >= 0) & (F.col("obi") > 0) & quiet & calm()
    return setup("block_retest", when, F.col("block_low") - 0.5 * F.col("atr"), F.col("swing_high"))


def footprint_absorption(least_levels: int = 3) -> Column:
    """Levels in a row of selling at the value area's low that do not push through it."""
    px, atr, edge = F.col("close"), F.col("atr"), F.col("value_low")
    band = F.array_sort(F.filter("levels", lambda x: (x["price"] >= edge - 0.5 * atr) & (x["price"] <= edge + 0.3 * atr)))
    sold = F.array_join(F.transform(band, lambda x: F.when(x["delta"] < 0, "1").otherwise("0")), "")
    when = (px > edge) & (px <= edge + 0.3 * atr) & sold.contains("1" * least_levels) & (F.col("obi") > 0) & (F.col("slope") > -0.05) & (F.col("taker") > -0.10)
    when = when & (F.col("regime") != F.col("against")) & (F.col("regime") != "stress") & calm()
    return setup("footprint_absorption", when, edge - atr, F.coalesce(F.when(F.col("poc") > px, F.col("poc")), F.col("value_high")))


def liquidation_hunt(least_z: float = 1.5, cascade: float = 3.0) -> Column:
    """A squeeze of the other side's positions with open interest and flow behind it, unless the crowd already stands there."""
    px, atr = F.col("close"), F.col("atr")
    crowded = (F.col("funding") > 0.0008) & (F.col("retail") - F.col("top") > 0.15)
    when = (F.col("liq_shorts") > F.col("liq_longs")) & (F.col("liq_shorts") > least_z) & (F.col("oi_slope") > 0) & (F.col("taker") > 0.15) & (F.col("slope") > 0)
    when = when & F.col("thin_above") & ~F.coalesce(crowded, F.lit(False)) & (F.col("liq_longs") < cascade)
    far = F.filter(F.concat(F.col("nodes"), F.array("value_high")), lambda x: x >= px + LEAST_REWARD * atr)
    return setup("liquidation_hunt", when, px - atr, F.array_min(far))


def funding_exhaustion(least_rate: float = 0.0008, cascade: float = 3.0) -> Column:
    """The other side pays dearly and is crowded while positions close: fade it."""
    px, atr = F.col("close"), F.col("atr")
    when = (F.col("funding") < -least_rate) & (F.col("top") > 0.48) & (F.col("retail") < 0.38) & (F.col("oi_slope") < 0) & (F.col("slope") >= 0) & (F.col("taker") > 0) & (F.col("liq_shorts") < cascade)
    stop = F.least(F.coalesce("value_low", px - 0.75 * atr), px - 0.75 * atr)
    return setup("funding_exhaustion", when, stop, F.coalesce(F.when(F.col("value_high") > px, F.col("value_high")), px + 2 * atr), None)


def crowd_fade(least: float = 0.20, cascade: float = 3.0) -> Column:
    """Large accounts long where small ones are short, funding confirms, at support, without a cascade."""
    px, atr = F.col("close"), F.col("atr")
    at_edge = px <= F.col("value_low") + 0.5 * atr
    when = (F.col("top") - F.col("retail") > least) & (F.col("funding") <= 0) & (F.col("oi_slope") < 1) & at_edge & (F.col("slope") >= 0) & (F.greatest("liq_shorts", "liq_longs") < cascade)
    return setup("crowd_fade", when, px - 1.5 * atr, F.coalesce(F.when(F.col("value_high") > px, F.col("value_high")), px + 3 * atr), None)


SETUPS = {f.__name__: f for f in (vacuum_breakout, book_breakout, block_retest, footprint_absorption, liquidation_hunt, funding_exhaustion, crowd_fade)}


def found(market: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``symbol, bucket, side, detector, entry, stop, target`` for every rule that holds."""
    all_ = F.array_compact(F.array(*[SETUPS[n]() for n in names or list(SETUPS)]))
    side = F.when(F.col("s") == 1, "long").otherwise("short")
    return sided(market).select("symbol", "bucket", side.alias("side"), F.explode(all_).alias("f")).select("symbol", "bucket", "side", "f.*")
