"""Looks at an unfinished bar: when a price is worth an evaluation, and how fresh the inputs are.

``Trigger`` is one symbol's state between bar closes; ``marketloom.streaming.intrabar`` keeps it in a stream. Batch runs it over a
(symbol, day): the rest after a signal ends with the UTC day, in a stream as well, so days are independent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Rules:
    """Fixed values."""

    apart_ms: int = 15_000
    most: int = 6
    move: float = 0.25
    fallback_ms: int = 60_000
    rest_ms: int = 120_000


LOOKS = "symbol string, ts_ms long, price double, nth int, moved double, why string, signal boolean"


@dataclass
class Trigger:
    """Rows in order of time: bar closes (``atr`` set) freeze the context, trades ask. ``fires`` says what the detector would answer."""

    symbol: str
    rules: Rules
    day: int = -1
    atr: float | None = None
    price: float = 0.0
    looked: int = 0
    count: int = 0
    fired: bool = False
    signalled: int = 0

    def dump(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("symbol", "rules")})

    @classmethod
    def load(cls, symbol: str, rules: Rules, kept: str) -> Trigger:
        return cls(symbol, rules, **json.loads(kept))

    def step(self, row: dict) -> tuple | None:
        ts, price, r = int(row["ts_ms"]), float(row["price"]), self.rules
        if ts // DAY_MS != self.day:
            self.day, self.signalled, self.atr = ts // DAY_MS, 0, None
        if row["is_close"]:
            self.atr, self.price, self.looked, self.count, self.fired = float(row["atr"]), price, ts, 0, False
            return None
        passed = max(0, ts - self.looked)
        if self.atr is None or self.fired or max(0, ts - self.signalled) < r.rest_ms or self.count >= r.most or price <= 0 or passed < r.apart_ms:
            return None
        moved = abs(price - self.price)
        far = self.atr > 0 and moved >= r.move * self.atr
        if not far and passed < r.fallback_ms:
            return None
        self.price, self.looked, self.count = price, ts, self.count + 1
        signal = bool(row["fires"])
        if signal:
            self.signalled, self.fired = ts, True
        return self.symbol, ts, price, self.count, moved, "move" if far else "time", signal


def looks(machine: Trigger, rows: pd.DataFrame) -> Iterator[tuple]:
    """A bar that closes at the time of a trade closes before it."""
    for row in rows.sort_values(["ts_ms", "is_trade", "seq"]).to_dict("records"):
        found = machine.step(row)
        if found:
            yield found


def asked(closes: DataFrame, trades: DataFrame) -> DataFrame:
    """Closes ``(symbol, ts_ms, price, atr)`` and trades ``(symbol, ts_ms, seq, price, fires)`` as rows of one kind."""
    a = closes.select("symbol", "ts_ms", F.lit(0).cast("long").alias("seq"), "price", "atr", F.lit(False).alias("fires"), F.lit(True).alias("is_close"), F.lit(0).alias("is_trade"))
    b = trades.select("symbol", "ts_ms", "seq", "price", F.lit(None).cast("double").alias("atr"), "fires", F.lit(False).alias("is_close"), F.lit(1).alias("is_trade"))
    return a.unionByName(b)


def intrabar_looks(closes: DataFrame, trades: DataFrame, rules: Rules | None = None) -> DataFrame:
    given = asdict(rules or Rules())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(looks(Trigger(rows["symbol"].iloc[0], Rules(**given)), rows)), columns=[c.split()[0] for c in LOOKS.split(", ")])

    rows = asked(closes, trades).withColumn("_day", F.floor(F.col("ts_ms") / DAY_MS))
    return rows.groupBy("symbol", "_day").applyInPandas(lambda x: run(x.drop(columns="_day")), LOOKS)


def age_text(age_ms: Column) -> Column:
    s = F.floor(age_ms / 1000)
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(age_ms.isNull(), "never").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long)


def freshness(bars: DataFrame, arrivals: DataFrame, sources: list[str], within_ms: int = 600_000, weights: dict[str, int] | None = None) -> DataFrame:
    """Of each bar ``(symbol, ts_ms)`` the age of the last arrival ``(symbol, source, ts_ms)`` of each source, and how many count as fresh.

    A source that has not delivered in the bar's day is stale: its age is null, "never". ``weights`` counts a source more than once.
    """
    weights = {s: (weights or {}).get(s, 1) for s in sources}
    day = F.floor(F.col("ts_ms") / DAY_MS)
    rows = arrivals.select("symbol", "ts_ms", "source", F.lit(0).alias("_bar")).unionByName(bars.select("symbol", "ts_ms", F.lit(None).cast("string").alias("source"), F.lit(1).alias("_bar")))
    by = Window.partitionBy("symbol", day).orderBy("ts_ms", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("*", *[(F.col("ts_ms") - F.last(F.when(F.col("source") == s, F.col("ts_ms")), True).over(by)).alias(f"age_{s}") for s in sources]).where("_bar = 1")
    fresh = sum(F.when(F.col(f"age_{s}") < within_ms, n).otherwise(0) for s, n in weights.items())
    return seen.select("symbol", "ts_ms", *[f"age_{s}" for s in sources], *[age_text(F.col(f"age_{s}")).alias(f"text_{s}") for s in sources], fresh.cast("int").alias("ok"), F.lit(sum(weights.values())).alias("total"))
