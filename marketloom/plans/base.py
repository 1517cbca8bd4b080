"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import HOUR
from ..operators.bars import time_bars
from ..sources.trades import trades

#: Price step of footprints and profiles: 5.00, 1.00.
WIDE, STEP = 500_000_000, 100_000_000

T = """t AS (
  SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, value AS price,
         CAST(round(value * 100000000) AS BIGINT) AS price_units,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, user_id % 2 = 1 AS is_sell
  FROM events
)"""


def bars_sql(name: str, interval_ms: int) -> str:
    return f"""{name} AS (
  SELECT symbol, ts_ms - ts_ms % {interval_ms} AS bucket,
         first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, seq) AS close,
         CAST(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END) AS BIGINT) AS buy_qty,
         CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty,
         CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n_trades,
         CAST(sum(CASE WHEN is_sell THEN -qty ELSE qty END) AS BIGINT) AS delta
  FROM t GROUP BY 1, 2
)"""


B = f"{T}, {bars_sql('b', HOUR)}"
#: Bars with their number, previous close and true range.
N = f"""{B}, n AS (
  SELECT *, row_number() OVER w AS n, lag(close) OVER w AS prev_close,
         coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket)
)"""
#: Outcomes: a result and a score for each event.
O = f"""{T}, o AS (
  SELECT symbol, ts_ms, seq, qty, is_sell, price, CAST(round(price * 100) AS BIGINT) % 7 / 2.0 - 1.25 AS r, qty / 100.0 AS score FROM t
)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_bars(trades(spark, sf_dir), HOUR)


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.indicators import by_time, true_range, with_number

    return with_number(hourly(spark, sf_dir)).withColumns({"prev_close": F.lag("close").over(by_time()), "tr": true_range()})


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.pmod(F.round(F.col("price") * 100).cast("long"), F.lit(7)) / 2.0 - 1.25
    return trades(spark, sf_dir).select("symbol", "ts_ms", "seq", "qty", "is_sell", "price", r.alias("r"), (F.col("qty") / 100.0).alias("score"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
