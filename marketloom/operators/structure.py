"""Market structure over bars: pivots, breaks, gaps, order blocks, sweeps and key levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY, in_session, week_start
from .indicators import by_time, rows


def pivots(bars: DataFrame, left: int, right: int) -> DataFrame:
    """Strict swing highs and lows; each is known only ``right`` bars later, at ``known_at``."""
    full = (F.count(F.lit(1)).over(rows(-left, -1)) == left) & (F.count(F.lit(1)).over(rows(1, right)) == right)
    highest = F.greatest(F.max("high").over(rows(-left, -1)), F.max("high").over(rows(1, right)))
    lowest = F.least(F.min("low").over(rows(-left, -1)), F.min("low").over(rows(1, right)))
    return bars.withColumns(
        {"swing_high": F.when(full & (F.col("high") > highest), F.col("high")), "swing_low": F.when(full & (F.col("low") < lowest), F.col("low")), "known_at": F.lead("bucket", right).over(by_time())}
    )


def confirmed_swings(bars: DataFrame, left: int, right: int) -> DataFrame:
    """The last swing high and low that each bar can know of."""
    found = pivots(bars, left, right)
    shifted = found.withColumns({f"_{c}": F.lag(c, right).over(by_time()) for c in ("swing_high", "swing_low")})
    last = {f"last_{c}": F.last(f"_{c}", True).over(rows(Window.unboundedPreceding)) for c in ("swing_high", "swing_low")}
    return shifted.withColumns(last).drop("_swing_high", "_swing_low")


def breaks(bars: DataFrame) -> DataFrame:
    """Breaks of structure and changes of character from ``close, last_swing_high, last_swing_low``: the bias persists.

    A break against the last bias is a change of character. The bias is that of the last break, so it is the
    last non-null side before the bar and needs no state of its own.
    """
    side = F.when(F.col("close") > F.col("last_swing_high"), 1).when(F.col("close") < F.col("last_swing_low"), -1)
    out = bars.withColumn("break_side", side)
    out = out.withColumn("bias_before", F.last("break_side", True).over(rows(Window.unboundedPreceding, -1)))
    kind = F.when(F.col("break_side").isNull(), "none").when(F.col("bias_before") == -F.col("break_side"), "change").otherwise("break")
    return out.withColumn("structure", kind)


def equal_extremes(bars: DataFrame, n: int, tolerance: float) -> DataFrame:
    """Rolling extremes including the bar, whether it meets the extreme before it, and sweeps of that extreme."""
    out = bars.withColumns({"roll_high": F.max("high").over(rows(-(n - 1))), "roll_low": F.min("low").over(rows(-(n - 1)))})
    out = out.withColumns({"prior_high": F.lag("roll_high").over(by_time()), "prior_low": F.lag("roll_low").over(by_time())})
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= F.col(b) * tolerance, F.lit(False))
    return out.withColumns(
        {
            "equal_high": near("high", "prior_high"), "equal_low": near("low", "prior_low"),
            "swept_high": F.coalesce((F.col("high") > F.col("prior_high")) & (F.col("close") < F.col("prior_high")), F.lit(False)),
            "swept_low": F.coalesce((F.col("low") < F.col("prior_low")) & (F.col("close") > F.col("prior_low")), F.lit(False)),
        }
    )


def shifts(bars: DataFrame, n: int = 300, least: int = 10) -> DataFrame:
    """Close beyond the extreme of all bars before it in the buffer, with more than ``least`` of them."""
    w = rows(-(n - 1), -1)
    enough = F.count(F.lit(1)).over(w) >= least
    side = F.when(enough & (F.col("close") > F.max("high").over(w)), "up").when(enough & (F.col("close") < F.min("low").over(w)), "down")
    return bars.withColumn("shift", F.coalesce(side, F.lit("none")))


def fair_value_gaps(bars: DataFrame, newest: int = 5) -> DataFrame:
    """Gaps between the bars around each bar that later bars left open, the newest of each side.

    A gap up spans the previous high and the next low; it is filled once a later low reaches its bottom.
    """
    around = bars.select(
        "symbol", "bucket", F.lag("high").over(by_time()).alias("ph"), F.lag("low").over(by_time()).alias("pl"), F.lead("high").over(by_time()).alias("nh"), F.lead("low").over(by_time()).alias("nl"),
        F.min("low").over(rows(2, Window.unboundedFollowing)).alias("later_low"), F.max("high").over(rows(2, Window.unboundedFollowing)).alias("later_high"),
    )
    up = F.struct(F.lit("up").alias("side"), F.col("ph").alias("bottom"), F.col("nl").alias("top"), (F.col("later_low") <= F.col("ph")).alias("filled"))
    down = F.struct(F.lit("down").alias("side"), F.col("nh").alias("bottom"), F.col("pl").alias("top"), (F.col("later_high") >= F.col("pl")).alias("filled"))
    gap = F.when(F.col("nl") > F.col("ph"), up).when(F.col("nh") < F.col("pl"), down)
    gaps = around.withColumn("g", gap).where("g is not null").select("symbol", "bucket", "g.*").where(~F.coalesce("filled", F.lit(False)))
    last = Window.partitionBy("symbol", "side").orderBy(F.col("bucket").desc())
    return gaps.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= newest).drop("filled")


def order_blocks(bars: DataFrame, newest: int = 5) -> DataFrame:
    """The last opposite candle before two bars that run beyond it, with its volume against the mean of 20."""
    ahead = lambda c, k: F.lead(c, k).over(by_time())
    up = (F.col("close") < F.col("open")) & (ahead("close", 1) > ahead("open", 1)) & (ahead("close", 2) > ahead("open", 2)) & (ahead("close", 2) > F.col("high"))
    down = (F.col("close") > F.col("open")) & (ahead("close", 1) < ahead("open", 1)) & (ahead("close", 2) < ahead("open", 2)) & (ahead("close", 2) < F.col("low"))
    ratio = F.try_divide("volume", F.avg("volume").over(rows(-19)))
    out = bars.withColumns({"side": F.when(up, "up").when(down, "down"), "volume_ratio": ratio, "known_at": ahead("bucket", 2)}).where("side is not null")
    last = Window.partitionBy("symbol", "side").orderBy(F.col("bucket").desc())
    return out.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= newest).select("symbol", "side", "bucket", "known_at", "high", "low", "volume_ratio", "nth")


def block_states(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """State of each block after all later bars: active, tested (touched), mitigated (past its middle), invalidated (closed beyond it).

    What all later bars reached is a running extreme from the end of the series, looked up at the bar from which a block is known.
    """
    later = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    reach = {"_low": F.min("low"), "_low_close": F.min("close"), "_high": F.max("high"), "_high_close": F.max("close")}
    seen = bars.select("symbol", F.col("bucket").alias("known_at"), *[f.over(later).alias(k) for k, f in reach.items()])
    out = blocks.join(seen, ["symbol", "known_at"], "left")
    up, middle = F.col("side") == "up", (F.col("high") + F.col("low")) / 2
    ends = lambda below, above: F.when(up, below).otherwise(above)
    state = (
        F.when(ends(F.col("_low_close") < F.col("low"), F.col("_high_close") > F.col("high")), "invalidated").when(ends(F.col("_low") <= middle, F.col("_high") >= middle), "mitigated")
        .when(ends(F.col("_low") <= F.col("high"), F.col("_high") >= F.col("low")), "tested").otherwise("active")
    )
    return out.withColumn("state", state).drop(*reach)


def key_levels(bars: DataFrame) -> DataFrame:
    """Extremes of the day before (present or by the calendar), day and week open, and Asia's extremes, for each day."""
    asia = in_session(F.col("bucket"), "asia")
    d = F.floor(F.col("bucket") / DAY).cast("long")
    days = bars.groupBy("symbol", d.alias("day")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "bucket").alias("day_open"),
        F.max(F.when(asia, F.col("high"))).alias("asia_high"), F.min(F.when(asia, F.col("low"))).alias("asia_low"),
        F.floor(F.min(week_start(F.col("bucket"))) / DAY).cast("long").alias("week"),
    )
    by_day, week = Window.partitionBy("symbol").orderBy("day"), Window.partitionBy("symbol", "week").orderBy("day")
    calendar = F.lag("day").over(by_day) == F.col("day") - 1
    eight = by_day.rangeBetween(-8, -1)
    return days.select(
        "symbol", "day", "day_open", "asia_high", "asia_low", F.first("day_open").over(week).alias("week_open"),
        F.lag("high").over(by_day).alias("prev_high"), F.lag("low").over(by_day).alias("prev_low"),
        F.when(calendar, F.lag("high").over(by_day)).alias("yesterday_high"), F.when(calendar, F.lag("low").over(by_day)).alias("yesterday_low"),
        F.max("high").over(eight).alias("week_high"), F.min("low").over(eight).alias("week_low"),
    )


def regime(bars: DataFrame, n: int = 20) -> DataFrame:
    """Trend, chop or expansion from slopes and range in units of the mean true range (``tr``, ``n`` of ``with_number``)."""
    w, short = rows(-(n - 1)), rows(-4)
    atr = F.avg("tr").over(rows(-13))
    slow = F.try_divide(F.regr_slope(F.col("close"), F.col("n")).over(w), atr)
    fast = F.try_divide(F.regr_slope(F.col("close"), F.col("n")).over(short), atr)
    spread = F.try_divide(F.max("high").over(w) - F.min("low").over(w), atr)
    out = bars.withColumns({"slow": slow, "fast": fast, "spread": spread})
    named = (
        F.when((F.col("slow") > 0.12) & (F.col("fast") > -0.35), "trend_up")
        .when((F.col("slow") < -0.12) & (F.col("fast") < 0.35), "trend_down")
        .when(F.col("spread") > 8, "expansion")
        .otherwise("chop")
    )
    return out.withColumn("regime", named)


def cooldown(rows_: DataFrame, key: str, order: str, gap: int, part: int = 86_400_000) -> DataFrame:
    """Rows at least ``gap`` after the last one kept, from the first on: the choice depends on choices before it.

    A row's successor is the first row ``gap`` or more after it, whatever was kept before, so only the chain of successors from
    the first row has to be followed. Each part of ``part`` in ``order`` tells where a chain that enters it at any of its rows
    leaves it; one pass over a key's parts follows the chain, and then each part follows it inside.
    """
    names = rows_.columns
    parted = rows_.withColumn("_part", F.floor(F.col(order) / part).cast("long"))

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        """For the entries of a part: the last row of the chain, in a compact form (from, last)."""
        x = np.unique(rows[order].to_numpy())
        after = np.searchsorted(x, x + gap)
        last = x.copy()
        for i in range(len(x) - 1, -1, -1):
            if after[i] < len(x):
                last[i] = last[after[i]]
        return pd.DataFrame({key: rows[key].iloc[0], "_part": rows["_part"].iloc[0], "entries": [x.tolist()], "lasts": [last.tolist()]})

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        out, free = [], None
        for p, entries, lasts in rows.sort_values("_part")[["_part", "entries", "lasts"]].itertuples(index=False):
            at = 0 if free is None else int(np.searchsorted(entries, free))
            if at < len(entries):
                out.append((rows[key].iloc[0], p, int(entries[at])))
                free = int(lasts[at]) + gap
        return pd.DataFrame(out, columns=[key, "_part", "_entry"])

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, *[c for c in names if c != order]])
        free, kept = rows["_entry"].iloc[0], []
        for x in rows[order]:
            kept.append(x >= free)
            free = x + gap if kept[-1] else free
        return rows.loc[kept, names]

    of_key = rows_.select(key).schema[0].dataType.simpleString()
    slim = parted.select(key, "_part", order).groupBy(key, "_part").applyInPandas(ends, f"`{key}` {of_key}, _part long, entries array<long>, lasts array<long>")
    entered = slim.groupBy(key).applyInPandas(follow, f"`{key}` {of_key}, _part long, _entry long")
    return parted.join(entered, [key, "_part"]).groupBy(key, "_part").applyInPandas(keep, rows_.schema)


def nearest_level(price: Column, levels: Column, above: bool) -> Column:
    """The nearest level beyond the price, from an array; null if there is none."""
    return F.array_min(F.filter(levels, lambda x: x > price)) if above else F.array_max(F.filter(levels, lambda x: x < price))
