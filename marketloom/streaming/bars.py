"""Structured Streaming forms of the batch operators.

A bar is emitted once, when the watermark passes its end; later trades of it are dropped, which is the
declared policy. The update mode without a watermark is the form that takes late trades at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulate import TRADES, Account, Rules
from ..sources.trades import event_trades


def trade_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they land."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return event_trades(raw).withColumn("ts", F.timestamp_millis("ts_ms"))


def final_bars(trades: DataFrame, interval: str, late: str) -> DataFrame:
    """Bars in append mode: each when it is final. State is one row for each open bar."""
    order = F.struct("ts_ms", "seq")
    window = F.window("ts", interval)
    return (
        trades.withWatermark("ts", late).groupBy("symbol", window.alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum(F.when(~F.col("is_sell"), F.col("qty")).otherwise(0)).alias("buy_qty"), F.sum(F.when(F.col("is_sell"), F.col("qty")).otherwise(0)).alias("sell_qty"),
        )
        .select("symbol", F.unix_millis("w.start").alias("bucket"), "open", "high", "low", "close", "buy_qty", "sell_qty")
    )


def sliding_sums(trades: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Volumes by side over sliding windows."""
    w = F.window("ts", width, step)
    sums = trades.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.sum(F.when(F.col("is_sell"), F.col("qty")).otherwise(0)).alias("sells"), F.sum(F.when(~F.col("is_sell"), F.col("qty")).otherwise(0)).alias("buys"))
    return sums.select("symbol", F.unix_millis("w.end").alias("until"), "sells", "buys")


def distinct_trades(trades: DataFrame, late: str) -> DataFrame:
    """A trade that is delivered twice counts once, within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def paper_stream(bars: DataFrame, rules: Rules) -> DataFrame:
    """The paper account on a stream of bars with optional signals (side, entry, stop, target): closed trades, state by symbol."""
    columns = [c.split()[0] for c in TRADES.split(", ")]
    state = "day long, opens long, lost_r double, halted boolean, balance double, peak double, last_open long, last_ms long, position array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        account = Account(key[0], rules)
        if kept.exists:
            restore(account, kept.get)
        for rows in batches:
            for row in rows.sort_values("bucket").to_dict("records"):
                account.step(row, row if isinstance(row.get("side"), str) else None)
        kept.update(snapshot(account))
        yield pd.DataFrame(account.closed, columns=columns)

    return bars.groupBy("symbol").applyInPandasWithState(step, TRADES, state, "append", GroupStateTimeout.NoTimeout)


FIELDS = ("side", "opened", "entry", "stop", "target", "size", "risk", "best", "worst", "funding", "fees", "realised", "partial")


def snapshot(a: Account) -> tuple:
    p = a.position
    return (a.day, a.opens, a.lost_r, a.halted, a.balance, a.peak, a.last_open, a.last_ms, [float(getattr(p, f)) for f in FIELDS] if p else None)


def restore(a: Account, kept: tuple) -> None:
    from ..operators.simulate import Position

    a.day, a.opens, a.lost_r, a.halted, a.balance, a.peak, a.last_open, a.last_ms, p = kept
    if p is not None:
        named = dict(zip(FIELDS, p, strict=True))
        a.position = Position(**{**named, "side": int(named["side"]), "opened": int(named["opened"]), "partial": bool(named["partial"])})
