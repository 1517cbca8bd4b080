"""Profiles that move with the bars: of the last bars, by counts that come and go, and of the week or month so far.

Volumes are whole numbers (of lots, or of millionths where a bar spreads over bins), so that running counts are exact
and no order of adding them matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY

WEEK, MONTH = 7 * DAY, 30 * DAY
#: Bars of a chunk of the rolling profile, besides those of the window before it.
CHUNK = 8192
MOVING = "symbol string, n long, poc double, value_high double, value_low double, thin_below double"


def grown(counts: np.ndarray, at: int, share: float, ties_up: bool) -> tuple[int, int]:
    """First and last bin of the value area around ``at``: the larger neighbour joins until ``share`` of all is inside."""
    low = high = at
    inside, wanted, last = counts[at], counts.sum() * share, len(counts) - 1
    while inside < wanted and (low > 0 or high < last):
        below = counts[low - 1] if low > 0 else -1
        above = counts[high + 1] if high < last else -1
        if above > below or (above == below and ties_up):
            high += 1
            inside += above
        else:
            low -= 1
            inside += below
    return low, high


class Moving:
    """Counts of ``bins`` equal bins between the lowest and highest close of a window.

    While the extremes stay, a bar that enters adds its volume and the one that leaves takes its own away; new extremes move every
    bin, and only then is the window counted anew.
    """

    def __init__(self, close: np.ndarray, volume: np.ndarray, window: int, bins: int):
        self.close, self.volume, self.window, self.bins = close, volume, window, bins
        self.low = self.high = np.nan
        self.recounts = 0

    def bin_of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.edges, x, "right") - 1, self.bins - 1)

    def step(self, i: int, low: float, high: float) -> None:
        """The window of bars ``i - window`` to ``i - 1``; called for each ``i`` in turn."""
        if (low, high) != (self.low, self.high):
            self.low, self.high = low, high
            self.edges = np.linspace(low, high, self.bins + 1)
            part = slice(i - self.window, i)
            self.counts = np.zeros(self.bins, np.int64)
            np.add.at(self.counts, self.bin_of(self.close[part]), self.volume[part])
            self.recounts += 1
        else:
            goes, comes = i - self.window - 1, i - 1
            self.counts[self.bin_of(self.close[goes])] -= self.volume[goes]
            self.counts[self.bin_of(self.close[comes])] += self.volume[comes]

    def levels(self, price: float) -> tuple[float, float, float, float | None]:
        """Point of control (the lowest of equal ones), ends of the value area, and the thinnest bin that lies wholly under the price."""
        middle = (self.edges[:-1] + self.edges[1:]) / 2
        poc = int(np.argmax(self.counts))
        low, high = grown(self.counts, poc, 0.70, True)
        under = int(np.searchsorted(self.edges[1:], price, "right"))
        thin = middle[int(np.argmin(self.counts[:under]))] if under else None
        return middle[poc], middle[high], middle[low], thin


def moving(rows: pd.DataFrame, begins: int, window: int, bins: int) -> Iterator[tuple]:
    """Levels of the bars from number ``begins`` on that have a full window before them."""
    n, close, volume = (rows[c].to_numpy() for c in ("n", "close", "volume"))
    before = pd.Series(close).rolling(window)
    low, high = before.min().shift(1).to_numpy(), before.max().shift(1).to_numpy()
    state = Moving(close, volume.astype(np.int64), window, bins)
    for i in range(window, len(rows)):
        if n[i] < begins:
            continue
        if high[i] - low[i] < 1e-6:
            state.low = np.nan  # a flat window has no profile
            continue
        state.step(i, low[i], high[i])
        yield int(n[i]), *state.levels(close[i])


def rolling_profile(bars: DataFrame, window: int = 300, bins: int = 50, chunk: int = CHUNK) -> DataFrame:
    """``poc``, ``value_high``, ``value_low`` and ``thin_below`` of the ``window`` bars before each bar ``n`` (from 1); null without them.

    A symbol is cut into chunks of bars, each with the window before it, so its history never meets in one task.
    """
    own = F.floor(F.col("n") / chunk)
    placed = bars.select("symbol", "n", "close", F.col("volume").cast("long").alias("volume"), F.explode(F.sequence(own, F.floor((F.col("n") + window) / chunk))).alias("_chunk"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = list(moving(rows.sort_values("n", ignore_index=True), int(key[1]) * chunk, window, bins))
        out = pd.DataFrame(found, columns=["n", "poc", "value_high", "value_low", "thin_below"])
        return out.assign(symbol=key[0])[["symbol", "n", "poc", "value_high", "value_low", "thin_below"]]

    found = placed.groupBy("symbol", "_chunk").applyInPandas(run, MOVING)
    return bars.join(found, ["symbol", "n"], "left")


PERIOD = "symbol string, bucket long, poc double, value_high double, value_low double"
#: Bins of a period's profile, and what its volumes are counted in.
BINS, UNIT = 50, 1_000_000


def period_levels(rows: pd.DataFrame, bins: int = BINS) -> pd.DataFrame:
    """Levels of one period as they stand after each of its bars.

    The first bars with a range fix the bins for the whole period; volume outside them is lost. A bar's volume spreads over the bins in
    proportion to its range (at least a tenth of a bin). The largest bin of equal ones is the highest; the value area grows down first.
    """
    rows = rows.sort_values("bucket", ignore_index=True)
    high, low, volume = (rows[c].to_numpy(float) for c in ("high", "low", "volume"))
    top, bottom = np.maximum.accumulate(high), np.minimum.accumulate(low)
    wide = np.flatnonzero(top - bottom > 0)
    out = np.full((len(rows), 3), np.nan)
    if len(wide):
        k = wide[0]
        step = (top[k] - bottom[k]) / bins
        middle = bottom[k] + np.arange(bins) * step + step * 0.5
        length = np.maximum(high - low, step * 0.1)
        shared = np.minimum(high[:, None], middle + step * 0.5) - np.maximum(low[:, None], middle - step * 0.5)
        spread = np.rint(volume[:, None] * np.maximum(shared, 0.0) / length[:, None] * UNIT).astype(np.int64)
        spread[:k] = 0
        for i, counts in enumerate(np.cumsum(spread, axis=0)):
            if i >= k and counts.any():
                poc = bins - 1 - int(np.argmax(counts[::-1]))
                first, last = grown(counts, poc, 0.70, False)
                out[i] = middle[poc], middle[last], middle[first]
    return pd.DataFrame({"symbol": rows["symbol"], "bucket": rows["bucket"], "poc": out[:, 0], "value_high": out[:, 1], "value_low": out[:, 2]})


def period_profile(bars: DataFrame, period_ms: int, name: str, bins: int = BINS) -> DataFrame:
    """``bars`` with ``{name}_poc``, ``{name}_value_high``, ``{name}_value_low`` of their period so far and ``{name}_location`` of the close.

    Periods of ``period_ms`` count from the epoch. A period of a symbol is a group: 43,200 minutes for 30 days.
    """
    slim = bars.select("symbol", "bucket", "high", "low", "volume", F.floor(F.col("bucket") / period_ms).alias("_period"))
    found = slim.groupBy("symbol", "_period").applyInPandas(lambda rows: period_levels(rows, bins), PERIOD)
    found = found.select("symbol", "bucket", *[F.nanvl(c, F.lit(None).cast("double")).alias(f"{name}_{c}") for c in ("poc", "value_high", "value_low")])
    return bars.join(found, ["symbol", "bucket"], "left").withColumn(f"{name}_location", location(F.col("close"), F.col(f"{name}_value_low"), F.col(f"{name}_value_high")))


def location(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "above_value").when(price < low, "below_value").when(high.isNotNull(), "in_value")


def closed_periods(bars: DataFrame, period_ms: int, name: str) -> DataFrame:
    """Of each bar, the levels with which the period before it in the data ended."""
    cols = [f"{name}_{c}" for c in ("poc", "value_high", "value_low")]
    period = F.floor(F.col("bucket") / period_ms).alias("_period")
    ends = bars.groupBy("symbol", period).agg(F.max_by(F.struct(*cols), F.when(F.col(cols[0]).isNotNull(), F.col("bucket"))).alias("_end"))
    before = ends.select("symbol", "_period", *[F.lag(F.col(f"_end.{c}")).over(Window.partitionBy("symbol").orderBy("_period")).alias(f"prior_{c}") for c in cols])
    return bars.withColumn("_period", period).join(before, ["symbol", "_period"], "left").drop("_period")


AREAS = "symbol string, n long, va_poc double, va_high double, va_low double"


def value_areas(bars: DataFrame, window: int, step: float, chunk: int = CHUNK) -> DataFrame:
    """``va_poc``, ``va_high``, ``va_low`` of the last ``window`` bars, the current one included: volumes at the price steps next to their closes.

    The largest steps until 70 % of the volume is inside, the lower of equal ones first; the point of control is the highest of equal ones.
    Volumes come and go with their bars; chunks as in ``rolling_profile``.
    """
    own = F.floor(F.col("n") / chunk)
    level = F.round(F.col("close") / step).cast("long").alias("level")
    placed = bars.select("symbol", "n", level, F.col("volume").cast("long").alias("volume"), F.explode(F.sequence(own, F.floor((F.col("n") + window - 1) / chunk))).alias("_chunk"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        held: dict[int, int] = {}
        out = []
        for i, (n, level, volume) in enumerate(zip(rows["n"], rows["level"], rows["volume"], strict=True)):
            held[level] = held.get(level, 0) + volume
            if i >= window:
                gone = rows["level"][i - window]
                held[gone] -= rows["volume"][i - window]
                if not any(rows["level"][i - window + 1 : i + 1] == gone):
                    del held[gone]
            if n >= int(key[1]) * chunk:
                total, inside, chosen = sum(held.values()), 0, []
                for at in sorted(held, key=lambda x: (-held[x], x)):
                    chosen.append(at)
                    inside += held[at]
                    if inside >= 0.70 * total:
                        break
                out.append((key[0], n, max(held, key=lambda x: (held[x], x)) * step, max(chosen) * step, min(chosen) * step))
        return pd.DataFrame(out, columns=[c.split()[0] for c in AREAS.split(", ")])

    return bars.join(placed.groupBy("symbol", "_chunk").applyInPandas(run, AREAS), ["symbol", "n"])
