"""Managers with memory: trailing exits, resting limit orders, vanishing orders, chased prices, event-based averages.

Each is a small state class or loop over one symbol's ordered rows, run in ``applyInPandas``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TRAILED = "symbol string, opened long, closed long, side string, entry double, exit double, reason string, r double"


@dataclass
class Trail:
    """Fixed stop until ``start`` R in favour, then a stop ``width`` behind the best price and never under ``start`` R.

    The best price counts the bar before the stop is tested. Results are in units of the first risk.
    """

    side: int
    opened: int
    entry: float
    stop: float
    target: float
    width: float
    start: float
    risk: float = 0.0
    best: float = 0.0

    def __post_init__(self) -> None:
        self.risk = (self.entry - self.stop) * self.side
        self.best = self.entry

    def bar(self, high: float, low: float) -> tuple[float, str] | None:
        self.best = max(self.best, high) if self.side > 0 else min(self.best, low)
        if (self.best - self.entry) * self.side >= self.start * self.risk:
            floor = self.entry + self.side * self.start * self.risk
            trailed = self.best - self.side * self.width
            moved = max(floor, trailed) if self.side > 0 else min(floor, trailed)
            self.stop = max(self.stop, moved) if self.side > 0 else min(self.stop, moved)
        if (low <= self.stop) if self.side > 0 else (high >= self.stop):
            return self.stop, "trail" if (self.stop - self.entry) * self.side > 0 else "stop"
        if (high >= self.target) if self.side > 0 else (low <= self.target):
            return self.target, "target"
        return None


def trailed_trades(bars: DataFrame, signals: DataFrame, start_r: float = 1.5, width_risks: float = 1.2) -> DataFrame:
    """One trade at a time for each symbol, entered at a signal's price after its bar."""
    joined = bars.select("symbol", "bucket", "high", "low").join(signals, ["symbol", "bucket"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        now: Trail | None = None
        out = []
        for b in rows.sort_values("bucket").to_dict("records"):
            if now and (hit := now.bar(b["high"], b["low"])):
                out.append((b["symbol"], now.opened, b["bucket"], "long" if now.side > 0 else "short", now.entry, hit[0], hit[1], (hit[0] - now.entry) * now.side / now.risk))
                now = None
            if not now and isinstance(b["side"], str):
                side = 1 if b["side"] == "long" else -1
                risk = (b["entry"] - b["stop"]) * side
                if risk > 0:
                    now = Trail(side, b["bucket"], b["entry"], b["stop"], b["target"], width_risks * risk, start_r)
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRAILED.split(", ")])

    return joined.groupBy("symbol").applyInPandas(run, TRAILED)


FILLED = "symbol string, order_id long, placed long, filled long, price double"


@dataclass
class LimitBook:
    """Resting buys: filled when a trade passes the price by the margin, dropped after their time; near copies of resting ones are refused."""

    margin_bps: float
    ttl_ms: int
    near: float
    resting: dict[int, tuple[float, int]] = field(default_factory=dict)

    def place(self, order_id: int, price: float, ts: int) -> bool:
        if any(abs(price - p) < self.near for p, _ in self.resting.values()):
            return False
        self.resting[order_id] = (price, ts)
        return True

    def trade(self, price: float, ts: int) -> list[tuple[int, float, int]]:
        self.resting = {i: (p, t) for i, (p, t) in self.resting.items() if ts - t <= self.ttl_ms}
        hit = [(i, p, t) for i, (p, t) in self.resting.items() if price <= p * (1 - self.margin_bps / 1e4)]
        for i, _, _ in hit:
            del self.resting[i]
        return hit


def limit_fills(orders: DataFrame, trades: DataFrame, margin_bps: float, ttl_ms: int, near: float) -> DataFrame:
    """Fills of orders (symbol, order_id, ts_ms, price) by trades (symbol, ts_ms, seq, price); an order rests before a trade of its time."""
    placed = orders.selectExpr("symbol", "ts_ms", "order_id as seq", "price", "0 as kind")
    both = placed.unionByName(trades.selectExpr("symbol", "ts_ms", "seq", "price", "1 as kind"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        book, out = LimitBook(margin_bps, ttl_ms, near), []
        for r in rows.sort_values(["ts_ms", "kind", "seq"]).itertuples():
            if r.kind == 0:
                book.place(r.seq, r.price, r.ts_ms)
            else:
                out += [(r.symbol, i, t, r.ts_ms, p) for i, p, t in book.trade(r.price, r.ts_ms)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in FILLED.split(", ")])

    return both.groupBy("symbol").applyInPandas(run, FILLED)


def vanished_orders(levels: DataFrame, factor: float = 5.0, near: float = 0.0005, within_ms: int = 500) -> DataFrame:
    """Large orders close to the mid that go within a short time, from updates (symbol, ts_ms, seq, price, qty, mid, mean_qty)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen: dict[float, int] = {}
        out = []
        for r in rows.sort_values(["ts_ms", "seq"]).itertuples():
            if r.qty > factor * r.mean_qty and abs(r.price - r.mid) <= near * r.mid:
                seen.setdefault(r.price, r.ts_ms)
            elif r.price in seen:
                since = seen.pop(r.price)
                if r.qty == 0 and r.ts_ms - since <= within_ms:
                    out.append((r.symbol, r.price, since, r.ts_ms))
        return pd.DataFrame(out, columns=["symbol", "price", "seen_ms", "gone_ms"])

    return levels.groupBy("symbol").applyInPandas(run, "symbol string, price double, seen_ms long, gone_ms long")


def chases(quotes: DataFrame, least: int = 3) -> DataFrame:
    """State of the best price (symbol, ts_ms, seq, price): chasing after ``least`` moves in one direction, fading once it turns."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        last, run_, state, out = None, 0, "idle", []
        for r in rows.sort_values(["ts_ms", "seq"]).itertuples():
            move = 0 if last is None else (r.price > last) - (r.price < last)
            if move:
                turned = run_ * move < 0
                run_ = move if turned else run_ + move
                state = "fading" if turned and state == "chasing" else "chasing" if abs(run_) >= least else state if not turned else "idle"
            last = r.price
            out.append((r.symbol, r.seq, state))
        return pd.DataFrame(out, columns=["symbol", "seq", "state"])

    return quotes.groupBy("symbol").applyInPandas(run, "symbol string, seq long, state string")


def imbalance_averages(samples: DataFrame, fast: float = 0.1, slow: float = 0.017) -> DataFrame:
    """Two averages of (imbalance + 1) / 2 by update and not by time, from (symbol, ts_ms, seq, imbalance)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_ms", "seq"])
        a = b = 0.5
        out = []
        for r in rows.itertuples():
            x = (r.imbalance + 1) / 2
            a, b = a + fast * (x - a), b + slow * (x - b)
            out.append((r.symbol, r.seq, a, b))
        return pd.DataFrame(out, columns=["symbol", "seq", "fast", "slow"])

    return samples.groupBy("symbol").applyInPandas(run, "symbol string, seq long, fast double, slow double")
