"""Phases of a range, a false break and the turn after it: a state machine whose bounds move with the bars.

``Phases`` is one symbol's machine; a bar is one ``step``. Its state is a few numbers and at most ``Rules.window``
bars of history, so that it goes into one string and back: ``marketloom.streaming.phases`` keeps it as the state of a
stream, ``phase_signals`` runs it over history. History needs one ordered pass over a symbol's bars (not trades), so a
symbol is a group: half a million rows for a year of minutes.

* **range**: the last ``least`` bars span a band of ``narrow`` to ``wide`` percent. While closes stay strictly inside, the
  bounds widen to each bar, its delta adds up and bars with absorption are counted; a band too wide or too long ends it.
* **break**: a close outside, on volume, either toxic or against its own delta. Anything else ends the range.
* **turn**: within ``wait`` bars a close back inside the broken bound, on volume, with reward enough to the nearest level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Bands in percent of the price, lengths in bars."""

    narrow: float = 0.06
    wide: float = 0.45
    least: int = 15
    most: int = 50
    break_volume: float = 2.0
    toxic: float = 0.60
    turn_volume: float = 2.5
    buffer: float = 0.08
    reward: float = 2.0
    cooldown: int = 45
    wait: int = 6
    most_liquidation: float = 999.0
    least_stretch: float = 0.0
    least_risk: float = 1.0
    warmup: int = 60
    window: int = 50


#: Level lists that a turn may aim at, in the order that decides ties; the edge of value comes after them.
LEVELS = ("thin", "naked", "blocks", "gaps")
#: Optional inputs of a bar beside ``symbol, bucket, high, low, close, volume, delta``, and what a missing one counts as.
CONTEXT = {
    "vpin": None, "stretch": None, "value_low": None, "value_high": None, "trend": None, "oi_change": None, "liquidation": 0.0, "session_cvd": 0.0, "big_cvd": 0.0,
    "absorbed_bid": False, "absorbed_ask": False, "bid_wall": False, "ask_wall": False,
}
SIGNAL = (
    "symbol string, bucket long, side string, entry double, stop double, target double, source string, reward double, range_high double, range_low double, range_bars int, "
    "range_cvd double, extreme double, break_volume double, break_delta double, break_z double, turn_volume double, turn_z double, absorbed_bars int, absorbed_break boolean, quality int, "
    "bars_to_turn int, extension double, zone string, with_trend boolean, score double, sizing double"
)


def missing(x: Any) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def nearest_target(sign: int, entry: float, risk: float, levels: list[tuple[str, list[float]]]) -> tuple[float, str]:
    """The nearest level at least half a risk ahead (``sign`` 1: above), the first named of equal ones; two risks where there is none."""
    ahead = [(abs(x - entry), k, x, name) for k, (name, found) in enumerate(levels) for x in found if not missing(x) and sign * x > sign * (entry + sign * risk * 0.5)]
    if not ahead:
        return entry + sign * risk * 2.0, "two_risks"
    _, _, level, name = min(ahead, key=lambda a: a[:2])
    return level, name


def quality(sign: int, broke: dict, bar: dict, high: float, low: float, entry: float) -> int:
    """Up to ten points for a turn of ``sign`` after the false break ``broke``; dollars are coins times the entry."""
    edge, bound = (bar["value_high"], high) if sign < 0 else (bar["value_low"], low)
    points = [
        (min(broke["absorbed_bars"], 2), True),
        (2, broke["absorbed"]),
        (2, sign * broke["delta"] > 0),
        (2, broke["vr"] >= 3.0),
        (1, 2.0 <= broke["vr"] < 3.0),
        (1, not missing(broke["stretch"]) and abs(broke["stretch"]) >= 1.5),
        (1, broke["liquidation"] < 1.2),
        (1, sign * bar["session_cvd"] * entry > 500_000.0),
        (1, not missing(edge) and abs(bound - edge) / edge < 0.007),
        (1, bar["ask_wall"] if sign < 0 else bar["bid_wall"]),
        (1, sign * broke["big_cvd"] * entry > 100_000.0),
    ]
    return min(10, sum(n for n, holds in points if holds))


def zone(bucket: int) -> str:
    minute = bucket // 60_000 % 1440
    return "London" if 420 <= minute < 540 else "NewYork" if 810 <= minute < 930 else ""


@dataclass
class Phases:
    symbol: str
    rules: Rules
    seen: int = 0
    signalled: int = 0
    stage: str = "idle"
    high: float = 0.0
    low: float = 0.0
    cvd: float = 0.0
    bars: int = 0
    absorbed_bars: int = 0
    broke: dict = field(default_factory=dict)
    volumes: list[float] = field(default_factory=list)
    deltas: list[float] = field(default_factory=list)
    tail: list[list[float]] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("symbol", "rules")})

    @classmethod
    def load(cls, symbol: str, rules: Rules, kept: str) -> Phases:
        return cls(symbol, rules, **json.loads(kept))

    def step(self, bar: dict) -> dict | None:
        """The signal of this bar, if it is a turn."""
        bar = {**bar, **{c: other if missing(bar.get(c)) else bar[c] for c, other in CONTEXT.items()}}
        r = self.rules
        self.seen += 1
        self.volumes = [*self.volumes, float(bar["volume"])][-r.window :]
        self.deltas = [*self.deltas, float(bar["delta"])][-r.window :]
        self.tail = [*self.tail, [float(bar["high"]), float(bar["low"])]][-r.least :]
        if self.seen < r.warmup or self.seen - self.signalled < r.cooldown:
            return None
        return {"idle": self.watch, "range": self.hold, "break": self.turn}[self.stage](bar)

    def volume_ratio(self, bar: dict) -> float:
        mean = sum(self.volumes) / len(self.volumes)
        return bar["volume"] / mean if mean > 0 else 1.0

    def delta_z(self, bar: dict) -> float:
        if len(self.deltas) < 5:
            return 0.0
        mean = sum(self.deltas) / len(self.deltas)
        spread = (sum((d - mean) ** 2 for d in self.deltas) / len(self.deltas)) ** 0.5
        return (bar["delta"] - mean) / spread if spread >= 1e-8 else 0.0

    def watch(self, bar: dict) -> None:
        if len(self.tail) < self.rules.least:
            return
        high, low = max(h for h, _ in self.tail), min(x for _, x in self.tail)
        if self.rules.narrow <= (high - low) / bar["close"] * 100.0 <= self.rules.wide:
            self.stage, self.high, self.low = "range", high, low
            self.cvd, self.bars, self.absorbed_bars = sum(self.deltas[-self.rules.least :]), self.rules.least, 0

    def hold(self, bar: dict) -> None:
        r, close = self.rules, bar["close"]
        if self.low < close < self.high:
            high, low = max(self.high, bar["high"]), min(self.low, bar["low"])
            if (high - low) / close * 100.0 > r.wide or self.bars + 1 > r.most:
                self.stage = "idle"
                return
            self.high, self.low, self.cvd, self.bars = high, low, self.cvd + bar["delta"], self.bars + 1
            self.absorbed_bars = min(255, self.absorbed_bars + bool(bar["absorbed_bid"] or bar["absorbed_ask"]))
            return
        self.stage = "idle"
        vr = self.volume_ratio(bar)
        if not r.narrow <= (self.high - self.low) / close * 100.0 <= r.wide or vr < r.break_volume:
            return
        sign = -1 if close > self.high else 1  # of the turn that may follow
        toxic = not missing(bar["vpin"]) and bar["vpin"] > r.toxic
        stretched = missing(bar["stretch"]) or abs(bar["stretch"]) >= r.least_stretch
        if (toxic or sign * bar["delta"] > 0) and bar["liquidation"] <= r.most_liquidation and stretched:
            self.stage = "break"
            self.broke = {
                "sign": sign, "extreme": bar["high"] if sign < 0 else bar["low"], "vr": vr, "delta": bar["delta"], "z": self.delta_z(bar), "stretch": bar["stretch"], "liquidation": bar["liquidation"],
                "big_cvd": bar["big_cvd"], "absorbed": bool(bar["absorbed_ask"] if sign < 0 else bar["absorbed_bid"]), "absorbed_bars": self.absorbed_bars, "waited": 0,
            }

    def turn(self, bar: dict) -> dict | None:
        r, b, entry = self.rules, self.broke, bar["close"]
        if b["waited"] >= r.wait:
            self.stage = "idle"
            return None
        b["waited"] += 1
        sign = b["sign"]
        vr = self.volume_ratio(bar)
        if not (entry < self.high if sign < 0 else entry > self.low) or vr < r.turn_volume:
            return None
        stop = b["extreme"] * (1.0 - sign * r.buffer / 100.0)
        risk = abs(stop - entry)
        if risk < r.least_risk:
            return None
        levels = [(name, list(bar[name]) if bar.get(name) is not None else []) for name in LEVELS]
        target, source = nearest_target(sign, entry, risk, [*levels, ("value", [bar["value_high"] if sign > 0 else bar["value_low"]])])
        reward = abs(target - entry) / risk
        if reward < r.reward:
            return None
        self.signalled, self.stage = self.seen, "idle"
        points = quality(sign, b, bar, self.high, self.low, entry)
        bound = self.high if sign < 0 else self.low
        extension = max(0.0, -sign * (b["extreme"] - bound) / bound * 100.0)
        trend = None if missing(bar["trend"]) else (bar["trend"] == "Bull") == (sign > 0) and bar["trend"] in ("Bull", "Bear")
        parts = [points / 10 * 0.30, min(abs(b["z"]), 3.0) / 3.0 * 0.20, 0.15 if zone(bar["bucket"]) else 0.0, max(0, 6 - b["waited"]) / 5 * 0.15, 0.20 if trend else 0.0]
        score = min(1.0, sum(parts))
        sizing = 2.0 if score >= 0.70 else 1.5 if score >= 0.50 else 1.0 if score >= 0.30 else 0.5
        return {
            "symbol": self.symbol, "bucket": bar["bucket"], "side": "long" if sign > 0 else "short", "entry": entry, "stop": stop, "target": target, "source": source, "reward": reward,
            "range_high": self.high, "range_low": self.low, "range_bars": self.bars, "range_cvd": self.cvd, "extreme": b["extreme"], "break_volume": b["vr"], "break_delta": b["delta"], "break_z": b["z"],
            "turn_volume": vr, "turn_z": self.delta_z(bar), "absorbed_bars": b["absorbed_bars"], "absorbed_break": b["absorbed"], "quality": points, "bars_to_turn": b["waited"], "extension": extension,
            "zone": zone(bar["bucket"]), "with_trend": trend, "score": score, "sizing": sizing,
        }


def found(signals: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(signals, columns=[c.split()[0] for c in SIGNAL.split(", ")])


def inputs(bars: DataFrame) -> DataFrame:
    """The columns that the machine reads, of those that ``bars`` has."""
    return bars.select(*[c for c in ("symbol", "bucket", "high", "low", "close", "volume", "delta", *CONTEXT, *LEVELS) if c in bars.columns])


def steps(machine: Phases, rows: pd.DataFrame) -> Iterator[dict]:
    for bar in rows.sort_values("bucket").to_dict("records"):
        signal = machine.step(bar)
        if signal:
            yield signal


def phase_signals(bars: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Turns of all symbols over history."""
    given = asdict(rules or Rules())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return found(list(steps(Phases(rows["symbol"].iloc[0], Rules(**given)), rows)))

    return inputs(bars).groupBy("symbol").applyInPandas(run, SIGNAL)


def in_band(bars: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Bars with which a range could begin: whether the last ``least`` bars span the band."""
    from .indicators import rows

    r = rules or Rules()
    w = rows(-(r.least - 1))
    band = (F.max("high").over(w) - F.min("low").over(w)) / F.col("close") * 100.0
    return bars.withColumns({"band": band, "in_band": (F.count(F.lit(1)).over(w) == r.least) & band.between(r.narrow, r.wide)})
