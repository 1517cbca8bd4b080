"""Bars and footprints from trades.

A trade has ``symbol, ts_ms, seq, price, price_units, qty, is_sell``. First and last always mean the
order by (ts_ms, seq), so that results do not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import floor_time, round_to_side_step, round_to_step



def order() -> Column:
    return F.struct("ts_ms", "seq")


def buy_qty() -> Column:
    return F.sum(F.when(~F.col("is_sell"), F.col("qty")).otherwise(0))


def sell_qty() -> Column:
    return F.sum(F.when(F.col("is_sell"), F.col("qty")).otherwise(0))


def time_bars(trades: DataFrame, interval_ms: int) -> DataFrame:
    """Bars of buckets that hold a trade. One shuffle; trades combine before it."""
    return (
        trades.groupBy("symbol", floor_time(F.col("ts_ms"), interval_ms).alias("bucket"))
        .agg(
            F.min_by("price", order()).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order()).alias("close"),
            buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_trades"),
        )
        .withColumn("delta", F.col("buy_qty") - F.col("sell_qty"))
    )


def first_trade_bars(trades: DataFrame, interval_ms: int) -> DataFrame:
    """Candles that exist only as trades made them: flat at the first trade's price, with all volume."""
    return trades.groupBy("symbol", floor_time(F.col("ts_ms"), interval_ms).alias("bucket")).agg(
        F.min_by("price", order()).alias("price"), buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty")
    )


def existing_bars_only(trades: DataFrame, known: DataFrame, interval_ms: int) -> DataFrame:
    """Volume for the (symbol, bucket) of ``known``; other trades are dropped before the aggregation."""
    kept = trades.withColumn("bucket", floor_time(F.col("ts_ms"), interval_ms)).join(known.select("symbol", "bucket"), ["symbol", "bucket"], "left_semi")
    return kept.groupBy("symbol", "bucket").agg(buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty"))


def numbered(trades: DataFrame, part_ms: int = 86_400_000) -> DataFrame:
    """``n``: the place of each trade in its symbol, from 0, without one task for a symbol.

    Trades are ranked within (symbol, day), and days get the number of trades before them.
    """
    parted = trades.withColumn("_day", floor_time(F.col("ts_ms"), part_ms))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = parted.groupBy("symbol", "_day").count().select("symbol", "_day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("ts_ms", "seq")) - 1
    return parted.withColumn("_within", within).join(days, ["symbol", "_day"]).withColumn("n", F.col("_before") + F.col("_within")).drop("_day", "_before", "_within")


def tick_bars(trades: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` trades in a row; the last may hold fewer."""
    bar = F.floor(F.col("n") / size).cast("long").alias("bar")
    return numbered(trades).groupBy("symbol", bar).agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.min_by("price", order()).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order()).alias("close"),
        buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty"), F.count(F.lit(1)).alias("n_trades"),
    )


def footprint(trades: DataFrame, interval_ms: int, step: int, by_side: bool = False) -> DataFrame:
    """Volume by bucket and price bin: nearest bins, or sells down and buys up."""
    units = F.col("price_units")
    level = round_to_side_step(units, F.col("is_sell"), step) if by_side else round_to_step(units, step)
    return trades.groupBy("symbol", floor_time(F.col("ts_ms"), interval_ms).alias("bucket"), level.alias("level")).agg(
        buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty"),
        F.count_if(~F.col("is_sell")).alias("n_buys"), F.count_if(F.col("is_sell")).alias("n_sells"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
    )


def cluster(kind: str) -> Column:
    """What a footprint cell is measured by."""
    buy, sell = F.col("buy_qty"), F.col("sell_qty")
    return {"bid_ask": F.greatest(buy, sell), "delta": F.abs(buy - sell), "volume": buy + sell}[kind]


def points_of_control(cells: DataFrame, tie: str = "low") -> DataFrame:
    """The level of most volume of each bucket; ties go to the lowest (or highest) level."""
    total = F.col("buy_qty") + F.col("sell_qty")
    rank = F.struct(total, -F.col("level") if tie == "low" else F.col("level"))
    return cells.groupBy("symbol", "bucket").agg(F.max_by("level", rank).alias("poc"), F.max(total).alias("poc_qty"))


def first_touch(levels: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """``levels`` (symbol, at, level on the grid of ``step``) with ``touched``: the first later bar (symbol, at, lo, hi) whose range holds the level.

    Bars are spread over the levels of their range, and a level's next touch is the least that follows it: no bar meets all levels.
    """
    wanted = levels.select("symbol", "level").distinct()
    touches = bars.select("symbol", "at", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("level")).join(wanted, ["symbol", "level"], "left_semi")
    both = levels.select("symbol", "at", "level", F.lit(None).cast("long").alias("hit")).unionByName(touches.withColumn("hit", F.col("at")))
    # from the last bar back: a frame that only grows is one pass, one that shrinks is summed up anew for each row
    later = Window.partitionBy("symbol", "level").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("touched", F.min("hit").over(later)).where("hit is null").drop("hit")


def poc_status(pocs: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """``filled_at``: the first later bar whose rounded range holds the level; status none, naked or filled."""
    low, high = round_to_step(F.round(F.col("low") * 1e8).cast("long"), step), round_to_step(F.round(F.col("high") * 1e8).cast("long"), step)
    hit = first_touch(pocs.select("symbol", F.col("bucket").alias("at"), F.col("poc").alias("level")), bars.select("symbol", F.col("bucket").alias("at"), low.alias("lo"), high.alias("hi")), step)
    hit = hit.select("symbol", F.col("at").alias("bucket"), F.col("touched").alias("filled_at"))
    last = bars.groupBy("symbol").agg(F.max("bucket").alias("last"))
    out = pocs.join(hit, ["symbol", "bucket"], "left").join(last, "symbol")
    status = F.when(F.col("filled_at").isNotNull(), "filled").when(F.col("bucket") < F.col("last"), "naked").otherwise("none")
    return out.withColumn("status", status).drop("last")


def by_ticks(trades: DataFrame, size: int) -> DataFrame:
    """Trades with the number of the tick bar of ``size`` trades that they fall in, from 0."""
    return numbered(trades).withColumn("bar", F.floor(F.col("n") / size).cast("long"))


def tick_poc_status(trades: DataFrame, size: int, step: int) -> DataFrame:
    """The point of control of each tick bar, and how far from the last bar it was first met again, if it was."""
    t = by_ticks(trades, size)
    cells = t.groupBy("symbol", "bar", round_to_step(F.col("price_units"), step).alias("level")).agg(F.sum("qty").alias("q"))
    pocs = cells.groupBy("symbol", "bar").agg(F.max_by("level", F.struct("q", -F.col("level"))).alias("poc"))
    low, high = F.floor(F.min("price_units") / step) * step, F.ceil(F.max("price_units") / step) * step
    bars = t.groupBy("symbol", F.col("bar").alias("at")).agg(low.cast("long").alias("lo"), high.cast("long").alias("hi"))
    met = first_touch(pocs.select("symbol", F.col("bar").alias("at"), F.col("poc").alias("level")), bars, step)
    out = met.join(bars.groupBy("symbol").agg(F.max("at").alias("last")), "symbol")
    status = F.when(F.col("touched").isNotNull(), "filled").when(F.col("at") < F.col("last"), "naked").otherwise("none")
    return out.select("symbol", F.col("at").alias("bar"), F.col("level").alias("poc"), (F.col("last") - F.col("touched")).alias("filled_from_last"), status.alias("status"))


def tick_vwap(trades: DataFrame, size: int) -> DataFrame:
    """Running VWAP over tick bars, anew with each day that a bar begins in."""
    b = by_ticks(trades, size).groupBy("symbol", "bar").agg(
        F.min("ts_ms").alias("start"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts_ms", "seq")).alias("close"), F.sum("qty").alias("volume")
    )
    w = Window.partitionBy("symbol", F.floor(F.col("start") / 86_400_000)).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return b.select("symbol", "bar", (F.sum(typical * F.col("volume")).over(w) / F.sum("volume").over(w)).alias("vwap"))


def level_lookup(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """Volumes at the asked levels (symbol, bucket, level), zero where nothing traded."""
    found = asked.join(cells.select("symbol", "bucket", "level", "buy_qty", "sell_qty"), ["symbol", "bucket", "level"], "left")
    return found.fillna(0, ["buy_qty", "sell_qty"])


def largest_in(cells: DataFrame, earliest: int, latest: int, low: int, high: int) -> DataFrame:
    """Of the buckets in a time range: the largest measure of a cell within a price range, of any cell's side, and of a bucket's volume."""
    inside = F.col("level").between(low, high)
    c = cells.where(F.col("bucket").between(earliest, latest))
    per = c.groupBy("symbol", "bucket").agg(*[F.max(F.when(inside, cluster(k))).alias(k) for k in ("bid_ask", "delta", "volume")], F.max(cluster("bid_ask")).alias("cell"), F.sum(cluster("volume")).alias("bar"))
    names = {"bid_ask": "max_side", "delta": "max_delta", "volume": "max_volume", "cell": "max_cell", "bar": "max_bar"}
    return per.groupBy("symbol").agg(*[F.max(k).alias(v) for k, v in names.items()])


def cluster_scale(cells: DataFrame, kind: str, weight: float) -> DataFrame:
    """What each bucket's clusters are drawn to: its own largest, the largest in view, and the weighted mean of both, one if that is zero."""
    own = cells.groupBy("symbol", "bucket").agg(F.max(cluster(kind)).alias("own"))
    seen = own.groupBy("symbol").agg(F.max("own").alias("seen"))
    mixed = weight * F.col("seen") + (1 - weight) * F.col("own")
    return own.join(seen, "symbol").withColumn("hybrid", F.when(mixed <= 0, 1.0).otherwise(mixed))


def diagonal_imbalances(cells: DataFrame, step: int, threshold_pct: int) -> DataFrame:
    """Sells at a level against buys one step up; the larger must exceed the smaller by the threshold, strictly."""
    up = cells.select("symbol", "bucket", (F.col("level") - step).alias("level"), F.col("buy_qty").alias("buy_above"))
    met = cells.select("symbol", "bucket", "level", "sell_qty").join(up, ["symbol", "bucket", "level"])
    buy, sell, most = F.col("buy_above"), F.col("sell_qty"), 100 + threshold_pct
    side = F.when((sell > 0) & (buy * 100 > sell * most), "buy").when((buy > 0) & (sell * 100 > buy * most), "sell")
    return met.withColumn("side", side).where("side is not null")


def auction_ends(cells: DataFrame) -> DataFrame:
    """Lowest and highest level of each bucket with their volumes: an end where both sides traded is unfinished."""
    low, high = F.min(F.struct("level", "buy_qty", "sell_qty")), F.max(F.struct("level", "buy_qty", "sell_qty"))
    ends = cells.groupBy("symbol", "bucket").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("levels"))
    both = lambda end: (F.col(f"{end}.buy_qty") > 0) & (F.col(f"{end}.sell_qty") > 0)
    return ends.select("symbol", "bucket", "levels", F.col("low.level").alias("low_level"), F.col("high.level").alias("high_level"), both("low").alias("unfinished_low"), both("high").alias("unfinished_high"))


def resample(bars: DataFrame, interval_ms: int) -> DataFrame:
    """Bars of a longer interval from bars; buckets without volume are dropped."""
    return (
        bars.groupBy("symbol", floor_time(F.col("bucket"), interval_ms).alias("wide"))
        .agg(
            F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"),
            *[F.sum(c).alias(c) for c in ("buy_qty", "sell_qty", "volume", "n_trades", "delta")],
        )
        .where("volume > 0").withColumnRenamed("wide", "bucket")
    )


def missing_buckets(bars: DataFrame, interval_ms: int) -> DataFrame:
    """Buckets without a bar between a symbol's first and last."""
    ends = bars.groupBy("symbol").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    grid = ends.select("symbol", F.explode(F.sequence("first", "last", F.lit(interval_ms).cast("long"))).alias("bucket"))
    return grid.join(bars, ["symbol", "bucket"], "left_anti")


def upsert(candles: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last candle to arrive for each key."""
    rest = [c for c in candles.columns if c not in keys]
    return candles.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def tape(trades: DataFrame, interval_ms: int) -> DataFrame:
    """Number, volume and average size of buys and sells, with the buys' shares of each."""
    t = trades.groupBy("symbol", floor_time(F.col("ts_ms"), interval_ms).alias("bucket")).agg(
        F.count_if(~F.col("is_sell")).alias("n_buys"), F.count_if(F.col("is_sell")).alias("n_sells"), buy_qty().alias("buy_qty"), sell_qty().alias("sell_qty")
    )
    return t.select(
        "*", F.try_divide("n_buys", F.col("n_buys") + F.col("n_sells")).alias("count_share"), F.try_divide("buy_qty", F.col("buy_qty") + F.col("sell_qty")).alias("volume_share"),
        F.round(F.try_divide("buy_qty", "n_buys")).cast("long").alias("avg_buy"), F.round(F.try_divide("sell_qty", "n_sells")).cast("long").alias("avg_sell"),
    )


def heatmap_cells(trades: DataFrame, interval_ms: int, step: int) -> DataFrame:
    """Quantity and trades of each interval by side and price step: sells go down to their step, buys up."""
    level = round_to_side_step(F.col("price_units"), F.col("is_sell"), step).alias("level")
    return trades.groupBy("symbol", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(interval_ms))).alias("bucket"), "is_sell", level).agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("trades"))
