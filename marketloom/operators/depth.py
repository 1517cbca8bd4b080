"""Order books: state from messages, features of the best levels, and depth runs over time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = "symbol string, level long, is_bid boolean, start long, until long, qty long"


LEVELS = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.float64())]))
SAMPLES = pa.schema([("symbol", pa.string()), ("ts_ms", pa.int64()), ("seq", pa.int64()), ("bids", LEVELS), ("asks", LEVELS)])
#: Samples of a batch that a replay gives.
BATCH = 4_096


class Side(dict):
    """Quantity by price; ``prices`` are its keys in order, so that the best levels cost no sort of a deep side."""

    def __init__(self) -> None:
        super().__init__()
        self.prices: list[float] = []

    def put(self, price: float, qty: float) -> None:
        if qty:
            if price not in self:
                insort(self.prices, price)
            self[price] = qty
        elif self.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]

    def clear(self) -> None:
        super().clear()
        self.prices.clear()


@dataclass
class Book:
    """Two sides of price and quantity; snapshots replace, deltas set, quantity 0 deletes, older messages are ignored."""

    bids: Side = field(default_factory=Side)
    asks: Side = field(default_factory=Side)
    last_ms: int = -1

    def apply(self, ts_ms: int, kind: str, b: Iterable, a: Iterable) -> bool:
        if ts_ms < self.last_ms:
            return False
        self.last_ms = ts_ms
        if kind == "snapshot":
            self.bids.clear()
            self.asks.clear()
        for side, levels in ((self.bids, b), (self.asks, a)):
            for price, qty in levels:
                side.put(price, qty)
        return True

    def best(self, n: int) -> tuple[list, list]:
        """Prices of the best ``n`` levels of both sides."""
        return self.bids.prices[: -n - 1 : -1], self.asks.prices[:n]

    def top(self, n: int) -> tuple[list, list]:
        return tuple([(p, side[p]) for p in best] for side, best in zip((self.bids, self.asks), self.best(n), strict=True))


def flat_levels(levels: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, prices and quantities of lists of levels; a level without quantity is deleted, one without price is nan."""
    held = levels.combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    price, qty = (held.values.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("price", "qty"))
    return held.offsets.to_numpy(), price, np.nan_to_num(qty, nan=0.0)


def in_order(messages: pa.Table) -> Iterator[tuple]:
    """Place, time, type and levels of both sides of messages by (ts_ms, seq), from the first snapshot on."""
    ts, kind = messages["ts_ms"].to_numpy(), messages["type"].to_pylist()
    order = np.lexsort((messages["seq"].to_numpy(), ts))
    sides = [flat_levels(messages[c]) for c in ("b", "a")]
    known = False
    for i in order.tolist():
        known = known or kind[i] == "snapshot"
        if known:
            b, a = ([(p, q) for p, q in zip(price[ends[i] : ends[i + 1]].tolist(), qty[ends[i] : ends[i + 1]].tolist(), strict=True) if p == p] for ends, price, qty in sides)
            yield i, int(ts[i]), kind[i], b, a


def book_samples(messages: DataFrame, depth: int = 25, slot_ms: int = 0) -> DataFrame:
    """The best ``depth`` levels after every message whose book is not crossed; a (symbol, day) replays in its own task.

    With ``slot_ms`` the last such sample of each slot of time only. A day starts with its first snapshot, so days are
    independent and a symbol spreads over its days.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        symbol, seq = rows["symbol"][0].as_py(), rows["seq"].to_numpy()
        book, last = Book(), None
        held: list[tuple] = []
        for i, ts, kind, b, a in in_order(rows):
            if not book.apply(ts, kind, b, a):
                continue
            if slot_ms and last is not None and ts // slot_ms != last[0] // slot_ms:
                held.append(last)
                last = None
            bids, asks = book.best(depth)
            if bids and asks and bids[0] < asks[0]:
                last = (ts, int(seq[i]), bids, [book.bids[p] for p in bids], asks, [book.asks[p] for p in asks])
                if not slot_ms:
                    held.append(last)
            if len(held) >= BATCH:
                yield sampled(symbol, held)
                held = []
        yield sampled(symbol, held + [last] * bool(slot_ms and last))

    day = F.floor(F.col("ts_ms") / 86_400_000)
    schema = "symbol string, ts_ms long, seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    return messages.withColumn("_day", day).groupBy("symbol", "_day").applyInArrow(run, schema)


def sampled(symbol: str, samples: list[tuple]) -> pa.RecordBatch:
    def side(price: int) -> pa.Array:
        ends = np.cumsum([0] + [len(s[price]) for s in samples])
        flat = [pa.array(np.fromiter((x for s in samples for x in s[k]), np.float64, int(ends[-1]))) for k in (price, price + 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["price", "qty"]))

    columns = [pa.array([symbol] * len(samples), pa.string()), *[pa.array([s[k] for s in samples], pa.int64()) for k in (0, 1)], side(2), side(4)]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, SAMPLES.types, strict=True)], schema=SAMPLES)


def moment(rows: DataFrame) -> list[str]:
    """Columns that order samples: their time, and their sequence where they have one."""
    return [c for c in ("ts_ms", "seq") if c in rows.columns]


def depth_of(side: str, n: int) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda s, x: s + x["qty"])


def book_imbalance(n: int) -> Column:
    """(bids - asks) / (bids + asks) over the best ``n`` levels, 0 for an empty book."""
    b, a = depth_of("bids", n), depth_of("asks", n)
    return F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))


def near_liquidity(n: int) -> Column:
    """Sums and largest quantities of the best ``n`` levels of both sides; all zero if a side has fewer."""
    full = (F.size("bids") >= n) & (F.size("asks") >= n)
    most = lambda side: F.array_max(F.transform(F.slice(side, 1, n), lambda x: x["qty"]))
    made = {"near_bid": depth_of("bids", n), "near_ask": depth_of("asks", n), "max_bid": most("bids"), "max_ask": most("asks")}
    return F.struct(*[F.when(full, v).otherwise(0.0).alias(k) for k, v in made.items()])


def range_liquidity(side: str, low: Column, high: Column) -> Column:
    """Quantity between two prices, and the price and quantity of its largest level, the lowest of equals."""
    inside = F.filter(side, lambda x: (x["price"] >= low) & (x["price"] <= high))
    total = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["qty"])
    wall = F.array_max(F.transform(inside, lambda x: F.struct(x["qty"].alias("qty"), (-x["price"]).alias("down"))))
    return F.struct(total.alias("total"), F.coalesce(-wall["down"], F.lit(0.0)).alias("wall_price"), F.coalesce(wall["qty"], F.lit(0.0)).alias("wall_qty"))


def walls(side: str, n: int = 20, factor: float = 5.0) -> Column:
    """Prices of the best ``n`` levels with more than ``factor`` times their mean quantity."""
    top = F.slice(side, 1, n)
    mean = F.try_divide(depth_of(side, n), F.size(top))
    return F.transform(F.filter(top, lambda x: x["qty"] > factor * mean), lambda x: x["price"])


def thin(side: str, n: int = 10, factor: float = 0.3, least: int = 3) -> Column:
    top = F.slice(side, 1, n)
    mean = F.try_divide(depth_of(side, n), F.size(top))
    return F.size(F.filter(top, lambda x: x["qty"] < factor * mean)) >= least


def book_features(samples: DataFrame, *also: Column) -> DataFrame:
    """Mid, microprice, spread, imbalances of three depths, walls and thin zones."""
    bid, ask = F.element_at("bids", 1), F.element_at("asks", 1)
    mid = (bid["price"] + ask["price"]) / 2
    micro = F.try_divide(bid["price"] * ask["qty"] + ask["price"] * bid["qty"], bid["qty"] + ask["qty"])
    return samples.select(
        "symbol", *moment(samples), mid.alias("mid"), micro.alias("micro"), ((ask["price"] - bid["price"]) / mid * 1e4).alias("spread_bps"),
        *[book_imbalance(n).alias(f"obi{n}") for n in (5, 10, 20, 25)], walls("bids").alias("bid_walls"), walls("asks").alias("ask_walls"),
        thin("bids").alias("thin_below"), thin("asks").alias("thin_above"), depth_of("bids", 25).alias("bid_depth"), depth_of("asks", 25).alias("ask_depth"), *also,
    )


def book_bars(features: DataFrame, interval_ms: int = 60_000, also: tuple[Column, ...] = ()) -> DataFrame:
    """Means and extremes of the features of each interval, with its first and last mid."""
    bucket, when = F.col("ts_ms") - F.pmod("ts_ms", F.lit(interval_ms)), F.struct(*moment(features))
    return features.groupBy("symbol", bucket.alias("bucket")).agg(
        *[F.avg(f"obi{n}").alias(f"obi{n}_mean") for n in (5, 10, 20)], F.min("obi10").alias("obi10_min"), F.max("obi10").alias("obi10_max"),
        F.avg("spread_bps").alias("spread_mean"), F.min_by("mid", when).alias("mid_open"), F.max_by("mid", when).alias("mid_close"), F.count(F.lit(1)).alias("n_samples"), *also,
    )


def book_minutes(samples: DataFrame, interval_ms: int = 60_000, n: int = 5) -> DataFrame:
    """``book_bars`` of samples with the mean near liquidity of the best ``n`` levels, for archives of whole days; one pass over the samples."""
    features = book_features(samples, near_liquidity(n).alias("near"))
    return book_bars(features, interval_ms, tuple(F.avg(f"near.{c}").alias(f"{c}{n}") for c in ("near_bid", "near_ask", "max_bid", "max_ask")))


def book_seconds(features: DataFrame) -> DataFrame:
    """The last sample of each second."""
    rest = [c for c in features.columns if c != "symbol"]
    last = F.max_by(F.struct(*rest), F.struct(*moment(features))).alias("f")
    return features.groupBy("symbol", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(1000))).alias("second")).agg(last).select("symbol", "second", "f.*")


def ladder(levels: DataFrame, step: int) -> DataFrame:
    """Quantity by side and price bin: bids go down, asks up."""
    from ..functions.units import round_to_side_step

    return levels.groupBy("symbol", "is_bid", round_to_side_step(F.col("level"), F.col("is_bid"), step).alias("bin")).agg(F.sum("qty").alias("qty"))


@dataclass
class Runs:
    """Runs of one level from its samples.

    An equal quantity of the same side extends the last run, in a later sample only as long as it lasts; else it starts anew.
    Where the whole book had a gap before the sample, an equal quantity bridges it, however long, and another one lets the
    old run reach to now.
    """

    every: int
    runs: list[list] = field(default_factory=list)

    def see(self, ts: int, qty: int, is_bid: bool, gap: bool) -> None:
        last = self.runs[-1] if self.runs else None
        if last and last[3] == is_bid:
            if ts > last[1]:
                if gap and qty == last[2]:
                    last[1] = ts + self.every
                    return
                if gap:
                    last[1] = ts
            elif qty == last[2]:
                last[1] = max(last[1], ts + self.every)
                return
            else:
                last[1] = min(last[1], ts)
        elif last:
            last[1] = min(last[1], ts)
        self.runs.append([ts, ts + self.every, qty, is_bid])


def depth_runs(samples: DataFrame, every_ms: int) -> DataFrame:
    """Intervals of constant quantity by (symbol, level) from book samples (symbol, ts_ms, level, qty, is_bid).

    A sample is all rows of a symbol and time, levels on both sides summed by step before. A gap is one of the symbol's samples: over
    ``every_ms`` since the one before. A sample older than the one before it does not occur, as times are sorted.
    """
    times = samples.select("symbol", "ts_ms").distinct()
    before = F.lag("ts_ms").over(Window.partitionBy("symbol").orderBy("ts_ms"))
    gaps = times.withColumn("gap", F.coalesce(F.col("ts_ms") > before + every_ms, F.lit(False)))
    rows = samples.groupBy("symbol", "ts_ms", "level", "is_bid").agg(F.sum("qty").alias("qty")).join(gaps, ["symbol", "ts_ms"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state = Runs(every_ms)
        rows = rows.sort_values(["ts_ms", "is_bid"], ascending=[True, False])  # bids of a sample come first
        for ts, qty, is_bid, gap in zip(rows["ts_ms"], rows["qty"], rows["is_bid"], rows["gap"], strict=True):
            state.see(int(ts), int(qty), bool(is_bid), bool(gap))
        head = (rows["symbol"].iloc[0], rows["level"].iloc[0])
        out = [(*head, b, s, u, q) for s, u, q, b in state.runs if u > s]
        return pd.DataFrame(out, columns=["symbol", "level", "is_bid", "start", "until", "qty"])

    return rows.groupBy("symbol", "level").applyInPandas(run, RUNS)


def latest_runs(runs: DataFrame, low: int, high: int, alive_at: int) -> DataFrame:
    """The last run of each level in a price range, where it lasts to ``alive_at``."""
    last = F.max(F.struct("start", "until", "qty", "is_bid")).alias("r")
    found = runs.where(F.col("level").between(low, high)).groupBy("symbol", "level").agg(last)
    return found.select("symbol", "level", "r.*").where(F.col("until") >= alive_at)


def kept_runs(runs: DataFrame, oldest: int) -> DataFrame:
    """Runs that have not ended before ``oldest``."""
    return runs.where(F.col("until") >= oldest)


def largest_runs(runs: DataFrame, earliest: int, latest: int, low: int, high: int, least_value: float) -> DataFrame:
    """Largest quantity among runs that overlap a time and price range, and among those worth over ``least_value`` in quote currency."""
    met = runs.where((F.col("until") >= earliest) & (F.col("start") <= latest) & F.col("level").between(low, high))
    worth = F.col("qty") * (F.col("level") / 1e8)
    return met.groupBy("symbol").agg(F.max("qty").alias("max_qty"), F.coalesce(F.max(F.when(worth > least_value, F.col("qty"))), F.lit(0)).alias("max_sized"))


def coalesce_runs(runs: DataFrame, ratio: float) -> DataFrame:
    """Touching runs of a level and side with quantities within ``ratio`` become one, with the rounded mean quantity."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("start").to_dict("records"):
            base = out[-1] if out else None
            if base and base[4] >= r["start"] and abs(base[5] - r["qty"]) <= base[5] * ratio:
                n = base[6] + 1
                base[4], base[7], base[6] = max(base[4], r["until"]), base[7] + r["qty"], n
            else:
                out.append([r["symbol"], r["level"], r["is_bid"], r["start"], r["until"], r["qty"], 1, r["qty"]])
        return pd.DataFrame([(s, p, b, a, u, (total + n // 2) // n) for s, p, b, a, u, _, n, total in out], columns=["symbol", "level", "is_bid", "start", "until", "qty"])

    return runs.groupBy("symbol", "level", "is_bid").applyInPandas(merge, RUNS)
