"""Sources: trades, books and logs from files, and the adapter that reads an event table as trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import price_units

TRADE_CSV = "timestamp double, symbol string, side string, size double, price double, tickDirection string"
SPOT_CSV = "id long, timestamp long, price double, volume double, side string"
LEVELS = T.ArrayType(T.ArrayType(T.StringType()))
BOOK_JSON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("data", T.StructType([T.StructField("s", T.StringType()), T.StructField("b", LEVELS), T.StructField("a", LEVELS), T.StructField("u", T.LongType())])),
])

def event_trades(events: DataFrame) -> DataFrame:
    """Events as trades: ``symbol, ts_ms, seq, price, price_units, qty, is_sell``."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        price_units(F.col("value")).alias("price_units"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"),
        (F.col("user_id") % 2 == 1).alias("is_sell"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trades(spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_trades_csv(spark: SparkSession, path: str, positive: bool = True) -> DataFrame:
    """Futures trades in seconds; rows without a positive price are dropped, unless ``positive`` is false. Ties keep the order of the file, which no task shares (``multiLine``)."""
    raw = spark.read.schema(TRADE_CSV).option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).csv(path)
    return (raw.where("price > 0") if positive else raw).select(
        "symbol", F.round(F.col("timestamp") * 1000).cast("long").alias("ts_ms"), F.monotonically_increasing_id().alias("seq"),
        "price", price_units(F.col("price")).alias("price_units"), F.col("size").alias("qty"), (F.lower("side") == "sell").alias("is_sell"),
    )


def read_spot_csv(spark: SparkSession, path: str, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """Spot trades in milliseconds within ``[start_ms, end_ms)``."""
    raw = spark.read.schema(SPOT_CSV).option("header", True).csv(path)
    return raw.where((F.col("timestamp") >= start_ms) & (F.col("timestamp") < end_ms)).select(
        F.lit(symbol).alias("symbol"), F.col("timestamp").alias("ts_ms"), F.col("id").alias("seq"),
        "price", price_units(F.col("price")).alias("price_units"), F.col("volume").alias("qty"), (F.lower("side") == "sell").alias("is_sell"),
    )


def read_book_json(spark: SparkSession, path: str) -> DataFrame:
    """Book messages, one JSON per line: ``symbol, ts_ms, seq, type, b, a`` with levels as (price, qty) doubles; ``seq`` is the update's id if it has one."""
    raw = spark.read.text(path).select(F.from_json("value", BOOK_JSON).alias("m"), F.monotonically_increasing_id().alias("seq"))
    level = lambda side: F.transform(F.col(f"m.data.{side}"), lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("qty")))
    return raw.where("m.type in ('snapshot', 'delta')").select(F.col("m.data.s").alias("symbol"), F.col("m.ts").alias("ts_ms"), F.coalesce("m.data.u", "seq").alias("seq"), F.col("m.type").alias("type"), level("b").alias("b"), level("a").alias("a"))


def parse_force_orders(lines: DataFrame) -> DataFrame:
    """Liquidation events of a column ``value``: a SELL order liquidates longs. Field names differ by case only, so paths read them."""
    at = lambda path: F.get_json_object("value", f"$.{path}")
    m = lines.where((at("e") == "forceOrder") & at("o.S").isin("SELL", "BUY"))
    price = F.coalesce(F.nullif(at("o.ap").cast("double"), F.lit(0.0)), at("o.p").cast("double"))
    return m.select(
        at("o.s").alias("symbol"), at("o.T").cast("long").alias("ts_ms"), F.when(at("o.S") == "SELL", "long").otherwise("short").alias("liquidated"),
        price.alias("price"), at("o.q").cast("double").alias("qty"), (price * at("o.q").cast("double")).alias("usd"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log rows; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found.select(*columns) if columns else found


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A server's table in ranges of ``key``; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()
