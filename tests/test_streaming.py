"""Streams give what batches give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketloom.operators import bars, simulate
from marketloom.streaming import bars as st


@pytest.fixture
def landed(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for k in range(1, 5):
        e.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_final_bars_equal_batch_bars(spark, landed):
    hour = 3_600_000
    found = drain(spark, st.final_bars(st.trade_stream(spark, landed), "1 hour", "1 hour"), "final_bars").collect()
    batch = {(r.symbol, r.bucket): r for r in bars.time_bars(st.event_trades(spark.read.parquet(landed)), hour).collect()}
    assert found
    for r in found:
        b = batch[r.symbol, r.bucket]
        assert (r.open, r.high, r.low, r.close, r.buy_qty, r.sell_qty) == (b.open, b.high, b.low, b.close, b.buy_qty, b.sell_qty)
    open_still = set(batch) - {(r.symbol, r.bucket) for r in found}
    assert all(b >= max(k[1] for k in batch) - 2 * hour for _, b in open_still)


def test_sliding_sums_and_duplicates(spark, landed):
    t = st.trade_stream(spark, landed)
    assert drain(spark, st.sliding_sums(t, "2 hours", "1 hour", "1 hour"), "sliding").count() > 0
    assert drain(spark, st.distinct_trades(t.union(t), "1 day"), "distinct_trades").count() == spark.read.parquet(landed).count()


def test_paper_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = []
    for k in range(40):
        side = "long" if k % 6 == 0 else None
        rows.append(("a", k * 3_600_000, 10.0 + (k % 5), 9.0 - (k % 3), 10.0, side, 10.0, 8.5, 12.5))
    schema = "symbol string, bucket long, high double, low double, close double, side string, entry double, stop double, target double"
    b = spark.createDataFrame(rows, schema)
    b.where("bucket < 72000000").coalesce(1).write.parquet(str(tmp_path / "b/1"))
    b.where("bucket >= 72000000").coalesce(1).write.parquet(str(tmp_path / "b/2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b/*"))
    found = drain(spark, st.paper_stream(stream, simulate.Rules()), "paper").orderBy("opened").collect()
    s = b.where("side is not null").select("symbol", "bucket", "side", "entry", "stop", "target")
    batch = simulate.paper_account(b.select("symbol", "bucket", "high", "low", "close"), s).orderBy("opened").collect()
    assert [(r.opened, r.closed, r.reason, r.net) for r in found] == [(r.opened, r.closed, r.reason, r.net) for r in batch] and batch
