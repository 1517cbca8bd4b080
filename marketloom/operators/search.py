"""First event at which a moving series crosses a threshold of each row, by descent through blocks."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .depth import flat_levels

#: Samples of a block: about the root of a busy day's.
BLOCK = 1024
DAY_MS = 86_400_000


def first_crossing(orders: DataFrame, series: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """``orders(symbol, ts_ms, level, below)`` with ``hit_ms`` and ``hit_seq`` of the first sample of their day, not before them, at or beyond their level.

    ``below`` asks for ``value <= level``, else ``value >= level``. Samples ``(symbol, ts_ms, seq, value)`` of a (symbol, day) are numbered
    and cut into blocks. An order meets one row of its day, the blocks' bounds and last times, finds in it the block
    that it starts in and the first later block that crosses, and then meets these two blocks only: two equality joins, and no
    row for each pair of an order and a sample. Orders that nothing crosses have nulls.
    """
    day = F.floor(F.col("ts_ms") / DAY_MS).cast("long")
    number = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("ts_ms", "seq")) - 1
    s = series.select("symbol", "ts_ms", "seq", F.col(value).alias("_v"), day.alias("_day")).withColumn("_b", F.floor(number / block).cast("int"))
    sample = F.struct("ts_ms", "seq", F.col("_v").alias("v"))
    blocks = s.groupBy("symbol", "_day", "_b").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max("ts_ms").alias("last"), F.array_sort(F.collect_list(sample)).alias("_samples"))
    bounds = blocks.groupBy("symbol", "_day").agg(F.array_sort(F.collect_list(F.struct("_b", "lo", "hi", "last"))).alias("_blocks"))

    def crosses(low: Column, high: Column) -> Column:
        return F.when(F.col("below"), low <= F.col("level")).otherwise(high >= F.col("level"))

    asked = orders.withColumns({"_id": F.monotonically_increasing_id(), "_day": day}).join(bounds, ["symbol", "_day"], "left")
    # blocks end in order of time; samples of equal time may lie across two, hence the block whose end is not before the order
    start = F.filter("_blocks", lambda x: x["last"] >= F.col("ts_ms"))
    begins = F.get(start, F.lit(0))["_b"]
    later = F.get(F.filter(start, lambda x: (x["_b"] > begins) & crosses(x["lo"], x["hi"])), F.lit(0))["_b"]
    asked = asked.withColumn("_in", F.array_compact(F.array(begins, later))).drop("_blocks")
    met = asked.select("_id", "symbol", "_day", "ts_ms", "level", "below", F.explode("_in").alias("_b")).join(blocks.select("symbol", "_day", "_b", "_samples"), ["symbol", "_day", "_b"])
    hit = F.get(F.filter("_samples", lambda x: (x["ts_ms"] >= F.col("ts_ms")) & crosses(x["v"], x["v"])), F.lit(0))
    hits = met.select("_id", hit.alias("hit")).where("hit IS NOT NULL").groupBy("_id").agg(F.min(F.struct("hit.ts_ms", "hit.seq")).alias("hit"))
    return asked.drop("_in", "_day").join(hits, "_id", "left").select(*orders.columns, F.col("hit.ts_ms").alias("hit_ms"), F.col("hit.seq").alias("hit_seq"))


ENTRY = "id long, symbol string, hit_ms long, liq_ratio double, wall_dist double, wall_qty double, book_imbalance double"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
ENTRY_ARROW = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in (c.split() for c in ENTRY.split(", "))])


def first_at_or_beyond(values: np.ndarray, start: np.ndarray, level: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each order the first place from ``start`` on whose value is ``<= level``, or ``>= level`` where not ``below``; -1 if there is none.

    All orders climb and descend a tree of least and largest values together: about twice its height of steps.
    """
    found = np.full(len(start), -1)
    size = 1 << max(0, len(values) - 1).bit_length()
    for side in (True, False):
        sign = 1.0 if side else -1.0  # an upper level is a lower one of the negated values
        tree = np.full(2 * size, np.inf)
        tree[size : size + len(values)] = sign * values
        for n in (size >> k for k in range(1, size.bit_length())):
            tree[n : 2 * n] = np.minimum(tree[2 * n : 4 * n : 2], tree[2 * n + 1 : 4 * n : 2])
        asked = np.flatnonzero((below == side) & (start < len(values)) & ~np.isnan(level))
        node, wanted = start[asked] + size, sign * level[asked]
        climbing = np.arange(len(asked))
        while len(climbing):
            climbing = climbing[~(tree[node[climbing]] <= wanted[climbing])]
            up = node[climbing] + 1
            node[climbing] = up = up // (up & -up)  # the largest part that begins behind
            node[climbing[up == 1]] = 0
            climbing = climbing[up > 1]
        asked, wanted, node = asked[node > 0], wanted[node > 0], node[node > 0]
        while (node < size).any():
            inner = node < size
            left = 2 * node[inner]
            node[inner] = left + ~(tree[left] <= wanted[inner])
        found[asked] = node - size
    return np.where(found < len(values), found, -1)


class BookDay:
    """A (symbol, day)'s messages in order, from its first snapshot on, as flat arrays: places of prices among all that the day sets."""

    def __init__(self, rows: pa.Table):
        ts, seq = rows["ts_ms"].to_numpy(), rows["seq"].to_numpy()
        order = np.lexsort((seq, ts))
        snapshot = np.asarray(rows["type"].to_numpy(zero_copy_only=False) == "snapshot", bool)[order]
        order = order[int(snapshot.argmax()) if snapshot.any() else len(order) :]
        self.ts, self.seq, self.snapshot = ts[order], seq[order], snapshot[len(snapshot) - len(order) :]
        self.prices, self.sides = [], []
        for c in ("b", "a"):
            ends, price, qty = flat_levels(rows[c])
            count = np.diff(ends)[order]
            at = np.repeat(ends[:-1][order] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            message, price, qty = np.repeat(np.arange(len(order)), count), price[at], qty[at]
            priced = ~np.isnan(price)
            known, place = np.unique(price[priced], return_inverse=True)
            self.prices.append(known)
            self.sides.append((np.searchsorted(message[priced], np.arange(len(order) + 1)), place, qty[priced]))
        # of messages of one time and number the last one ends the step
        self.ends = np.append((self.ts[1:] != self.ts[:-1]) | (self.seq[1:] != self.seq[:-1]), True)[: len(order)]

    def mids(self) -> np.ndarray:
        """Mid after each message; nan where a side is empty, the book is crossed, or another message of that time and number follows."""
        out = np.full(len(self.ts), np.nan)
        prices = [p.tolist() for p in self.prices]
        sides = [(ends.tolist(), place.tolist(), qty.tolist()) for ends, place, qty in self.sides]
        held, heaps = [[0.0] * len(p) for p in prices], ([], [])  # heaps keep deleted prices until they come up
        for i, (snapshot, ends_step) in enumerate(zip(self.snapshot.tolist(), self.ends.tolist(), strict=True)):
            if snapshot:
                held, heaps = [[0.0] * len(p) for p in prices], ([], [])
            for sign, own, heap, (ends, place, qty) in zip((-1, 1), held, heaps, sides, strict=True):
                for j in range(ends[i], ends[i + 1]):
                    at = place[j]
                    if qty[j] and not own[at]:
                        heappush(heap, sign * at)
                    own[at] = qty[j]
                while heap and not own[sign * heap[0]]:
                    heappop(heap)
            if ends_step and heaps[0] and heaps[1]:
                bid, ask = prices[0][-heaps[0][0]], prices[1][heaps[1][0]]
                if bid < ask:
                    out[i] = (bid + ask) / 2
        return out

    def reached(self, asked: dict[str, list], reach: float) -> pa.Table:
        """``asked`` has ``at``, the message after which to look, and the columns of hits; hits where one side is empty in reach give no row."""
        out: list[tuple] = []
        held = [np.zeros(len(p)) for p in self.prices]
        sides = [(ends.tolist(), place.tolist(), qty.tolist()) for ends, place, qty in self.sides]
        snapshots = np.flatnonzero(self.snapshot)
        e, width = np.array(asked["entry"], np.float64), reach * np.array(asked["risk"], np.float64)
        spans = []  # of each side: first and end of the prices in reach
        for known, low, high in ((self.prices[0], e - width, e), (self.prices[1], e, e + width)):
            spans += [np.searchsorted(known, low, "left").tolist(), np.searchsorted(known, high, "right").tolist()]
        done = 0
        for k in np.argsort(np.array(asked["at"], np.int64), kind="stable").tolist():
            upto = asked["at"][k] + 1
            if upto > done:
                last = int(np.searchsorted(snapshots, upto)) - 1
                if last >= 0 and snapshots[last] >= done:  # what came before a snapshot is gone
                    done = int(snapshots[last])
                    for side in held:
                        side[:] = 0.0
                for side, (ends, place, qty) in zip(held, sides, strict=True):
                    for j in range(ends[done], ends[upto]):
                        side[place[j]] = qty[j]
                done = upto
            below, above = held[0][spans[0][k] : spans[1][k]], held[1][spans[2][k] : spans[3][k]]
            down, up = float(below.sum()), float(above.sum())
            if down > 0 and up > 0:
                is_long, risk = asked["is_long"][k], asked["risk"][k]
                known, first, target, ahead, behind = (self.prices[1], spans[2][k], above, up, down) if is_long else (self.prices[0], spans[0][k], below, down, up)
                wall = int(target.argmax())  # of equal ones the lowest price
                out.append((asked["id"][k], asked["symbol"][k], asked["hit_ms"][k], ahead / (behind + 1e-9), abs(float(known[first + wall]) - asked["entry"][k]) / risk, float(target[wall]), (ahead - behind) / (ahead + behind)))
        columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, ENTRY_ARROW.types, strict=True)], schema=ENTRY_ARROW)


def met_by_day(messages: DataFrame, asked: DataFrame, time: str, look: Callable[[BookDay, pa.Table], pa.Table]) -> DataFrame:
    """Rows of ``look`` for each (symbol, day), which replays in its own task with what is asked of it beside it."""

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return look(BookDay(rows), asked) if len(rows) and len(asked) else ENTRY_ARROW.empty_table()

    day = lambda ts: F.floor(F.col(ts) / DAY_MS).alias("_day")
    left = messages.select("symbol", "ts_ms", "seq", "type", "b", "a", day("ts_ms"))
    return left.groupBy("symbol", "_day").cogroup(asked.select("*", day(time)).groupBy("symbol", "_day")).applyInArrow(meet, ENTRY)


def entry_books(messages: DataFrame, hits: DataFrame, reach: float = 3.0) -> DataFrame:
    """What the book holds within ``reach`` risks of each entry, when the price comes to it.

    ``hits(id, symbol, entry, is_long, risk, hit_ms, hit_seq)``. A (symbol, day) replays in its own task, with its hits beside it, and sums whole
    sides, not the best levels; hits where one side is empty in reach give no row. Towards the target over behind, distance of the
    largest level towards the target in risks and its quantity, and the imbalance.
    """

    def look(day: BookDay, asked: pa.Table) -> pa.Table:
        steps = {step: i for i, step in enumerate(zip(day.ts.tolist(), day.seq.tolist(), strict=True))}
        at = np.array([steps.get(step, -1) for step in zip(asked["hit_ms"].to_pylist(), asked["hit_seq"].to_pylist(), strict=True)], np.int64)
        return day.reached({"at": at[at >= 0].tolist()} | asked.filter(pa.array(at >= 0)).to_pydict(), reach)

    right = hits.where("hit_ms IS NOT NULL AND risk > 0").select("id", "symbol", "entry", "is_long", "risk", "hit_ms", "hit_seq")
    return met_by_day(messages, right, "hit_ms", look)


def order_books(messages: DataFrame, orders: DataFrame, reach: float = 3.0) -> DataFrame:
    """``entry_books`` of ``orders(id, symbol, ts_ms, entry, is_long, risk)`` where the mid first comes to their entry, on their day and not before them.

    One replay of a (symbol, day) gives its mids, and all its orders find theirs in one tree over them. No sample and no hit leaves the task.
    """

    def look(day: BookDay, asked: pa.Table) -> pa.Table:
        mids = day.mids()
        samples = np.flatnonzero(~np.isnan(mids))
        start = np.searchsorted(day.ts[samples], asked["ts_ms"].to_numpy(), "left")
        level, below = (asked[c].to_numpy(zero_copy_only=False).astype(t) for c, t in (("entry", np.float64), ("is_long", bool)))
        hit = first_at_or_beyond(mids[samples], start, level, below)
        at = samples[hit[hit >= 0]]
        return day.reached({"at": at.tolist(), "hit_ms": day.ts[at].tolist()} | asked.filter(pa.array(hit >= 0)).to_pydict(), reach)

    right = orders.where("risk > 0 AND is_long IS NOT NULL").select("id", "symbol", "ts_ms", "entry", "is_long", "risk")
    return met_by_day(messages, right, "ts_ms", look)
