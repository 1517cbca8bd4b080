"""Trade simulation: state machines over a symbol's ordered bars and signals, for batch and stream alike.

``Account.step`` is one bar: funding, then closes, then opens, then equity. The same class runs inside
``applyInPandas`` over history and inside stateful streaming.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNDING_MS = 8 * 3_600_000
TRADES = (
    "symbol string, side string, opened long, closed long, entry double, exit double, size double, reason string, "
    "gross double, fees double, funding double, net double, r double, mfe_r double, mae_r double, balance double"
)


@dataclass
class Rules:
    balance: float = 10_000.0
    risk: float = 0.01
    leverage: float = 5.0
    fee_bps: float = 4.0
    slippage_bps: float = 2.0
    ttl_ms: int = 24 * 3_600_000
    cooldown_ms: int = 0
    max_per_day: int = 1_000
    partial_at_r: float | None = None
    partial_share: float = 0.5
    daily_loss_r: float = 1e9
    max_drawdown: float = 1.0


@dataclass
class Position:
    side: int
    opened: int
    entry: float
    stop: float
    target: float
    size: float
    risk: float
    best: float
    worst: float
    funding: float = 0.0
    fees: float = 0.0
    realised: float = 0.0
    partial: bool = False


@dataclass
class Account:
    symbol: str
    rules: Rules
    balance: float = 0.0
    peak: float = 0.0
    position: Position | None = None
    last_open: int | None = None
    last_ms: int | None = None
    day: int = -1
    opens: int = 0
    lost_r: float = 0.0
    halted: bool = False
    closed: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.balance = self.peak = self.rules.balance

    def step(self, bar: dict, signal: dict | None) -> None:
        day = bar["bucket"] // 86_400_000
        if day != self.day:
            self.day, self.opens, self.lost_r = day, 0, 0.0
        if self.position:
            self._fund(bar)
            self._manage(bar)
        if signal and not self.position:
            self._open(bar, signal)
        self.last_ms = bar["bucket"]

    def _fund(self, bar: dict) -> None:
        p = self.position
        since = max(p.opened, self.last_ms or p.opened)
        crossed = bar["bucket"] // FUNDING_MS - since // FUNDING_MS
        p.funding += crossed * bar.get("funding_rate", 0.0) * p.size * bar["close"] * p.side

    def _manage(self, bar: dict) -> None:
        """The stop before the target before the time limit; the partial before the target of the same bar."""
        p = self.position
        p.best = max(p.best, bar["high"]) if p.side > 0 else min(p.best, bar["low"])
        p.worst = min(p.worst, bar["low"]) if p.side > 0 else max(p.worst, bar["high"])
        if (bar["low"] <= p.stop) if p.side > 0 else (bar["high"] >= p.stop):
            self._close(bar, p.stop, "stop")
            return
        at = self.rules.partial_at_r
        if at is not None and not p.partial:
            level = p.entry + p.side * at * p.risk
            if (bar["high"] >= level) if p.side > 0 else (bar["low"] <= level):
                part = p.size * self.rules.partial_share
                p.realised += part * (level - p.entry) * p.side
                p.fees += part * level * self.rules.fee_bps / 1e4
                p.size, p.partial, p.stop = p.size - part, True, p.entry
        if (bar["high"] >= p.target) if p.side > 0 else (bar["low"] <= p.target):
            self._close(bar, p.target, "target")
        elif bar["bucket"] - p.opened >= self.rules.ttl_ms:
            self._close(bar, bar["close"], "ttl")

    def _open(self, bar: dict, signal: dict) -> None:
        rules = self.rules
        waits = self.last_open is not None and bar["bucket"] - self.last_open < rules.cooldown_ms
        if self.halted or waits or self.opens >= rules.max_per_day or self.lost_r >= rules.daily_loss_r:
            return
        side = 1 if signal["side"] == "long" else -1
        entry = signal["entry"] * (1 + side * rules.slippage_bps / 1e4)
        risk = (entry - signal["stop"]) * side
        if risk <= 0:
            return
        size = min(self.balance * rules.risk / risk, self.balance * rules.leverage / entry)
        self.position = Position(side, bar["bucket"], entry, signal["stop"], signal["target"], size, risk, entry, entry, fees=size * entry * rules.fee_bps / 1e4)
        self.last_open, self.opens = bar["bucket"], self.opens + 1

    def _close(self, bar: dict, price: float, reason: str) -> None:
        p, rules = self.position, self.rules
        exit_ = price * (1 - p.side * rules.slippage_bps / 1e4)
        whole = p.size / (1 - rules.partial_share) if p.partial else p.size
        gross = p.realised + p.size * (exit_ - p.entry) * p.side
        fees = p.fees + p.size * exit_ * rules.fee_bps / 1e4
        net = gross - fees - p.funding
        r = net / (whole * p.risk) if whole else 0.0
        self.balance += net
        self.peak = max(self.peak, self.balance)
        self.lost_r += max(0.0, -r)
        self.halted = self.halted or self.balance <= self.peak * (1 - rules.max_drawdown)
        mfe, mae = (p.best - p.entry) * p.side / p.risk, (p.worst - p.entry) * p.side / p.risk
        self.closed.append((self.symbol, "long" if p.side > 0 else "short", p.opened, bar["bucket"], p.entry, exit_, whole, reason, gross, fees, p.funding, net, r, mfe, mae, self.balance))
        self.position = None


def replay(symbol: str, rows: Iterable[dict], rules: Rules) -> list[tuple]:
    account = Account(symbol, rules)
    for row in rows:
        account.step(row, row if row.get("side") else None)
    return account.closed


def paper_account(bars: DataFrame, signals: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Closed trades of one account for each symbol; signals (symbol, bucket, side, entry, stop, target) act at their bar's close."""
    rules = rules or Rules()
    joined = bars.select("symbol", "bucket", "high", "low", "close").join(signals, ["symbol", "bucket"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        rows["side"] = rows["side"].where(rows["side"].notna(), None)
        return pd.DataFrame(replay(rows["symbol"].iloc[0], rows.to_dict("records"), rules), columns=[c.split()[0] for c in TRADES.split(", ")])

    return joined.groupBy("symbol").applyInPandas(run, TRADES)


def funding_crossings(start_ms, end_ms):
    """How many funding times lie in (start, end]."""
    return (F.floor(end_ms / FUNDING_MS) - F.floor(start_ms / FUNDING_MS)).cast("long")
