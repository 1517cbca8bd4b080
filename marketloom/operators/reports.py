"""Relational reports on signals and outcomes.

An outcome has ``key columns, ts_ms, seq, r`` (result in units of risk), and further columns by report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Share with no division by zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def performance(outcomes: DataFrame, *keys: str) -> DataFrame:
    wins = F.count_if(F.col("r") > 0)
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), wins.alias("wins"), F.count_if(F.col("r") < 0).alias("losses"), rate(wins, F.count(F.lit(1))).alias("win_rate"),
        F.round(F.avg("r"), 6).alias("avg_r"), F.round(F.sum("r"), 6).alias("sum_r"), F.round(F.avg(F.when(F.col("r") > 0, F.col("r"))), 6).alias("avg_win"),
    )


def fill_ratio(orders: DataFrame, *keys: str) -> DataFrame:
    placed, filled = F.count_if(F.col("event") == "place"), F.count_if(F.col("event") == "fill")
    return orders.groupBy(*keys).agg(placed.alias("placed"), filled.alias("filled"), rate(filled, placed).alias("fill_ratio"))


def score_buckets(rows: DataFrame, width: float = 0.05) -> DataFrame:
    bucket = F.floor(F.round(F.col("score") / width, 6)).cast("long")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("avg_r"), rate(F.count_if(F.col("r") > 0), F.count(F.lit(1))).alias("win_rate"))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """Exact interpolated quantiles by key."""
    got = [F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100)}") for p in shares]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *got)


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval, held in [0, 1]."""
    p, zz = wins / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.greatest(F.lit(0.0), (middle - half) / (1 + zz / n)), F.least(F.lit(1.0), (middle + half) / (1 + zz / n))


def rank_correlation(rows: DataFrame, x: str, y: str, key: str, tie: str, least: int = 30) -> DataFrame:
    """Correlation of ordinal ranks within each key (ties by ``tie``); 0 under ``least`` rows."""
    place = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(c, tie)).cast("double")
    ranked = rows.select(key, place(x).alias("x"), place(y).alias("y"))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= least, F.corr("x", "y")).otherwise(0.0), 6).alias("rho"))


def threshold_sweep(rows: DataFrame, value: str, key: str, least: int, shares: tuple[float, ...] = tuple(i / 100 for i in range(10, 95, 5))) -> DataFrame:
    """For each key the quantile threshold above which the mean result is best, with at least ``least`` rows; the lowest share wins ties."""
    cuts = rows.groupBy(key).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("c"))
    cuts = cuts.select(key, F.posexplode("c").alias("i", "cut")).withColumn("share", F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1))
    # a handful of thresholds for each key: the sums at and above each come from one pass over the rows
    met = rows.join(cuts, key).where(F.col(value) >= F.col("cut")).groupBy(key, "share", "cut").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("avg_r"))
    best = Window.partitionBy(key).orderBy(F.col("avg_r").desc(), "share")
    return met.where(F.col("n") >= least).withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")


def drawdown(outcomes: DataFrame, key: str) -> DataFrame:
    """Deepest fall of cumulative results from their running peak, with the start as the first peak."""
    w = Window.partitionBy(key).orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    total = outcomes.withColumn("total", F.sum("r").over(w))
    fall = F.greatest(F.lit(0.0), F.max("total").over(w)) - F.col("total")
    return total.withColumn("fall", fall).groupBy(key).agg(F.round(F.max("fall"), 6).alias("max_drawdown"), F.round(F.max_by("total", F.struct("ts_ms", "seq")), 6).alias("final_r"))


def equity(outcomes: DataFrame, key: str, risks: tuple[float, ...]) -> DataFrame:
    """Final equity of each risk fraction, compounding 1 + risk * r; a loss of everything ends at 0."""
    grown = lambda f: F.when(F.min(1 + F.lit(f) * F.col("r")) <= 0, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest(F.lit(f) * F.col("r"), F.lit(-0.999999))))))
    return outcomes.groupBy(key).agg(*[F.round(grown(f), 4).alias(f"equity_{round(f * 1000)}") for f in risks])


def monthly(outcomes: DataFrame, key: str) -> DataFrame:
    month = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM")
    return performance(outcomes.withColumn("month", month), key, "month")


def decay(buckets: DataFrame) -> DataFrame:
    """Buckets in order with the change of their mean result, and whether it rises."""
    w = Window.orderBy("bucket")  # a bucket a row: bounded by the scores' range
    change = F.col("avg_r") - F.lag("avg_r").over(w)
    return buckets.select("bucket", "n", "avg_r", F.round(change, 6).alias("change"), F.coalesce(change > 0, F.lit(True)).alias("rises"))


def data_quality(trades: DataFrame) -> DataFrame:
    """By symbol and day: trades, minutes with one, share of the day's minutes, longest silence, and whether the sequence follows time."""
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("long")
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms", "seq")
    t = trades.withColumn("day", day).withColumns({"gap": F.col("ts_ms") - F.lag("ts_ms").over(w), "back": F.col("seq") < F.lag("seq").over(w)})
    minutes = F.count_distinct(F.floor(F.col("ts_ms") / 60_000))
    return t.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n"), minutes.alias("minutes"), F.round(minutes / 1440, 6).alias("coverage"), F.max("gap").alias("longest_gap"),
        F.coalesce(~F.bool_or("back"), F.lit(True)).alias("in_order"),
    )


def keep_newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in order for each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def costs(closed: DataFrame, *keys: str) -> DataFrame:
    """Gross result and what fees, funding and slippage took of it, in percent of its size."""
    names = ("gross", "fees", "funding", "slippage")
    sums = closed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    taken = F.col("fees") + F.col("funding") + F.col("slippage")
    pct = lambda c: F.round(F.try_divide(c, F.abs("gross")) * 100, 4)
    return sums.withColumns({"cost_pct": pct(taken), "net_pct": pct(F.col("gross") - taken)}).withColumns({c: F.round(c, 4) for c in names})


def signal_summary(signals: DataFrame, *keys: str) -> DataFrame:
    """Signals, those with a result and those without, and the results' win rate, mean and sum."""
    closed = F.count("r")
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), closed.alias("closed"), (F.count(F.lit(1)) - closed).alias("open"), rate(F.count_if(F.col("r") > 0), closed, 6).alias("win_rate"),
        F.round(F.avg("r"), 6).alias("avg_r"), F.round(F.sum("r"), 6).alias("total_r"),
    )


def by_band(rows: DataFrame, value: str, bands: dict[str, tuple[float | None, float | None]], *keys: str) -> DataFrame:
    """Win rate and mean result by band of a value; a band's low end is in it, the high end too if no band before has it."""
    band = F.lit(None).cast("string")
    for name, (low, high) in reversed(bands.items()):
        inside = F.lit(True) if low is None else F.col(value) >= low
        inside = inside if high is None else inside & ((F.col(value) < high) if low is None else (F.col(value) <= high))
        band = F.when(inside, name).otherwise(band)
    rows = rows.where(F.col(value).isNotNull()).withColumn("band", band)
    return rows.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("r") > 0), F.count(F.lit(1)), 6).alias("win_rate"), F.round(F.avg("r"), 6).alias("avg_r"))


def discrimination(rows: DataFrame, *keys: str, least: int = 30) -> DataFrame:
    """Mean score of winners and of others, and the correlation of score and result from ``least`` rows on."""
    won = F.col("r") > 0
    return rows.groupBy(*keys).agg(
        F.round(F.avg(F.when(won, F.col("score"))), 6).alias("winners"), F.round(F.avg(F.when(~won, F.col("score"))), 6).alias("losers"),
        F.round(F.when(F.count(F.lit(1)) >= least, F.corr("score", "r")), 6).alias("r"),
    )


def contradictions(signals: DataFrame) -> DataFrame:
    """Signals of each day, and those whose side is not that of the one before."""
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("long")
    before = F.lag("is_sell").over(Window.partitionBy("symbol", "day").orderBy("ts_ms", "seq"))
    s = signals.withColumn("day", day).withColumn("before", before)
    return s.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("before") != F.col("is_sell")).alias("contradictions"))
