"""Volume and time profiles: value areas, nodes, single prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY, MINUTE
from ..functions.units import floor_to_step


def day_profile(trades: DataFrame, step: int) -> DataFrame:
    return trades.groupBy("symbol", F.floor(F.col("ts_ms") / DAY).cast("long").alias("day"), floor_to_step(F.col("price_units"), step).alias("level")).agg(F.sum("qty").alias("qty"))


def top_volume_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """Value area of the largest levels until their volume reaches ``share``; need not be contiguous. Ties take the lower level."""
    w = Window.partitionBy("symbol", "day")
    order = w.orderBy(F.col("qty").desc(), "level")
    ranked = profile.withColumns({"before": F.coalesce(F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("qty").over(w)})
    inside = F.col("before") < F.col("total") * share
    return ranked.groupBy("symbol", "day").agg(
        F.max_by("level", F.struct("qty", -F.col("level"))).alias("poc"), F.max(F.when(inside, F.col("level"))).alias("value_high"),
        F.min(F.when(inside, F.col("level"))).alias("value_low"), F.sum("qty").alias("qty"),
    )


def contiguous_area(profile: DataFrame, share: float = 0.7, ties_up: bool = True) -> DataFrame:
    """Value area grown from the point of control to the larger neighbour until it holds ``share``.

    A day's levels are an ordered array (bounded by its price range); a fold moves two ends over it.
    """
    levels = profile.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(F.struct("level", "qty"))).alias("rows"), F.sum("qty").alias("total"), F.max_by("level", F.struct("qty", -F.col("level"))).alias("poc"))
    poc = F.array_position(F.transform("rows", lambda r: r["level"]), F.col("poc")).cast("int")
    out = levels.withColumn("at", poc)
    size = F.size("rows")
    qty = lambda i: F.coalesce(F.get(F.col("rows"), i - 1)["qty"], F.lit(-1))

    def grow(s: Column, _: Column) -> Column:
        up = F.when(s["hi"] < size, qty(s["hi"] + 1)).otherwise(-1)
        down = F.when(s["lo"] > 1, qty(s["lo"] - 1)).otherwise(-1)
        take_up = (up >= down) if ties_up else (up > down)
        done = (s["sum"] >= F.col("total") * share) | ((up < 0) & (down < 0))
        moved = F.when(
            take_up, F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["sum"] + up).alias("sum"))
        ).otherwise(F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["sum"] + down).alias("sum")))
        return F.when(done, s).otherwise(moved)

    start = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), F.get(F.col("rows"), F.col("at") - 1)["qty"].alias("sum"))
    area = out.withColumn("area", F.aggregate("rows", start, grow))
    level = lambda i: F.get(F.col("rows"), F.col(f"area.{i}") - 1)["level"]
    return area.select("symbol", "day", "poc", level("lo").alias("value_low"), level("hi").alias("value_high"), F.col("area.sum").alias("inside"))


def nodes(profile: DataFrame, high: float = 2.0, low: float = 0.3) -> DataFrame:
    """Levels with far more or far less volume than the day's mean level."""
    mean = F.avg("qty").over(Window.partitionBy("symbol", "day"))
    kind = F.when(F.col("qty") > high * mean, "high").when(F.col("qty") < low * mean, "low")
    return profile.withColumn("node", kind).where("node is not null")


def single_prints(bars: DataFrame, step: int, period_ms: int = 30 * MINUTE) -> DataFrame:
    """Price levels that one period of the day visited only, merged into zones of neighbouring levels."""
    lo, hi = (floor_to_step(F.round(F.col(c) * 1e8).cast("long"), step) for c in ("low", "high"))
    visits = bars.select(
        "symbol", F.floor(F.col("bucket") / DAY).cast("long").alias("day"), F.floor(F.col("bucket") / period_ms).cast("long").alias("period"),
        F.explode(F.sequence(lo, hi, F.lit(step).cast("long"))).alias("level"),
    )
    once = visits.groupBy("symbol", "day", "level").agg(F.min("period").alias("period"), F.max("period").alias("last")).where("period = last")
    island = F.col("level") / step - F.row_number().over(Window.partitionBy("symbol", "day", "period").orderBy("level"))
    zones = once.withColumn("island", island.cast("long")).groupBy("symbol", "day", "period", "island")
    return zones.agg(F.min("level").alias("low_level"), F.max("level").alias("high_level"), F.count(F.lit(1)).alias("levels")).drop("island")
