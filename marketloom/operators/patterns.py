"""Shapes of candles and sequences of them, session baselines, and rolling features for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import region
from .indicators import by_time, rows


def candle_shapes() -> dict[str, Column]:
    """Conditions on one bar: long wicks over small bodies, and bodies that fill the bar."""
    size = F.col("high") - F.col("low") + 1e-9
    body = F.abs(F.col("close") - F.col("open")) / size
    up = (F.col("high") - F.greatest("close", "open")) / size
    down = (F.least("close", "open") - F.col("low")) / size
    return {"shooting_star": (up > 0.45) & (body < 0.40), "hammer": (down > 0.45) & (body < 0.40), "full_up": (body > 0.8) & (F.col("close") > F.col("open")), "full_down": (body > 0.8) & (F.col("close") < F.col("open"))}


def sequences(bars: DataFrame, named: dict[str, Column], lags: int = 1, recent: int = 3) -> DataFrame:
    """Columns of the conditions now, ``<name>_before`` (``lags`` bars ago) and ``<name>_recent`` (in any of the last ``recent`` bars)."""
    out = bars.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in named.items()})
    made = {}
    for n in named:
        made[f"{n}_before"] = F.coalesce(F.lag(n, lags).over(by_time()), F.lit(False))
        made[f"{n}_recent"] = F.max(n).over(rows(-(recent - 1)))
    return out.withColumns(made)


def forward_result(k: int) -> Column:
    """Change of the close over the next ``k`` bars, null where there are fewer."""
    return F.lead("close", k).over(by_time()) / F.col("close") - 1


def session_baseline(bars: DataFrame, cvd: str, large: Column) -> DataFrame:
    """``cvd_session``, ``large_session``, ``volume_session``: since the last bar that began Asia, London or New York.

    The overlap and the hours off go on with what runs. The bar that begins a session is its baseline of ``cvd``, and
    counts in its sums.
    """
    b = bars.withColumn("_region", region(F.col("bucket")))
    begins = (F.col("_region") != F.coalesce(F.lag("_region").over(by_time()), F.lit("off_hours"))) & F.col("_region").isin("asia", "london", "new_york")
    b = b.withColumn("_run", F.sum(begins.cast("int")).over(rows(Window.unboundedPreceding))).withColumn("_large", large)
    w = Window.partitionBy("symbol", "_run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    base = F.when(F.col("_run") > 0, F.first(cvd).over(w)).otherwise(0)
    return b.withColumns({"cvd_session": F.col(cvd) - base, "large_session": F.sum("_large").over(w), "volume_session": F.sum("volume").over(w)}).drop("_region", "_run", "_large")


def rolling_features(bars: DataFrame, spans: tuple[int, ...] = (10, 30), long: int = 120) -> DataFrame:
    """Flow, volume and return over each span in units of their long spread or mean; null under a quarter of a span, five bars at least."""

    def over(f: Column, k: int) -> Column:
        w = rows(-(k - 1))
        return F.when(F.count(F.lit(1)).over(w) >= max(5, k // 4), f.over(w))

    made = {}
    for k in spans:
        made[f"delta_{k}"] = over(F.sum("delta"), k) / ((over(F.stddev_samp("delta"), long) + 1e-9) * F.sqrt(F.lit(float(k))))
        made[f"volume_{k}"] = over(F.sum("volume"), k) / (over(F.avg("volume"), long) * k + 1e-9)
        made[f"return_{k}"] = (F.col("close") / F.lag("close", k).over(by_time()) - 1) * 1e4
    made["large"] = (F.col("volume") - over(F.avg("volume"), long)) / (over(F.stddev_samp("volume"), long) + 1e-9)
    made["imbalance"] = (over(F.sum("buy_qty"), spans[-1]) - over(F.sum("sell_qty"), spans[-1])) / (over(F.sum("buy_qty"), spans[-1]) + over(F.sum("sell_qty"), spans[-1]) + 1e-9)
    return bars.withColumns(made)
