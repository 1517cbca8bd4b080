"""Looks within bars, in a stream as in a batch; freshness; patches of a table in place."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import intrabar as op
from marketloom.sources import sinks
from marketloom.streaming.intrabar import look_stream

DAY = 86_400_000
R = op.Rules()


def close(ts, price=100.0, atr=4.0):
    return {"symbol": "s", "ts_ms": ts, "seq": 0, "price": price, "atr": atr, "fires": False, "is_close": True, "is_trade": 0}


def trade(ts, price, fires=False, seq=1):
    return {"symbol": "s", "ts_ms": ts, "seq": seq, "price": price, "atr": None, "fires": fires, "is_close": False, "is_trade": 1}


def run(rows):
    t = op.Trigger("s", R)
    return [(x[1], x[3], x[5], x[6]) for x in (t.step(r) for r in rows) if x]


def test_a_look_needs_a_close_a_move_and_time():
    t = 10 * DAY + 600_000
    assert run([trade(t, 200.0)]) == []  # nothing frozen yet
    assert run([close(t), trade(t + 14_999, 110.0), trade(t + 15_000, 100.9), trade(t + 15_001, 101.0)]) == [(t + 15_001, 1, "move", False)]
    assert run([close(t), trade(t + 59_999, 100.5), trade(t + 60_000, 100.5)]) == [(t + 60_000, 1, "time", False)]
    assert run([close(t, atr=0.0), trade(t + 20_000, 300.0), trade(t + 61_000, 100.0)]) == [(t + 61_000, 1, "time", False)]  # without a range only time counts
    assert run([close(t), trade(t + 60_000, 0.0), trade(t + 60_000, -1.0)]) == []


def test_looks_are_counted_and_moves_start_anew():
    t = 10 * DAY + 600_000
    many = [trade(t + 15_000 * k, 100.0 + 2 * k) for k in range(1, 12)]
    assert [x[1] for x in run([close(t), *many])] == [1, 2, 3, 4, 5, 6]
    assert run([close(t), trade(t + 15_000, 101.0), trade(t + 30_000, 101.5), trade(t + 45_000, 102.0)]) == [(t + 15_000, 1, "move", False), (t + 45_000, 2, "move", False)]


def test_a_signal_ends_the_bar_and_rests_over_the_next():
    t = 10 * DAY + 600_000
    rows = [close(t), trade(t + 20_000, 105.0, True), trade(t + 40_000, 110.0, True), close(t + 60_000, 110.0), trade(t + 90_000, 120.0), trade(t + 140_000, 130.0)]
    assert run(rows) == [(t + 20_000, 1, "move", True), (t + 140_000, 1, "move", False)]
    late = 11 * DAY - 10_000
    assert [x[0] for x in run([close(late - 30_000), trade(late, 105.0, True), close(late + 20_000), trade(late + 40_000, 110.0)])] == [late, late + 40_000]  # a day starts rested


def rows_of(seed):
    rng, out, x = random.Random(seed), [], 100.0
    for k in range(600):
        x += rng.uniform(-1, 1)
        ts = 20 * DAY - 40 * 60_000 + k * 7_000
        out.append((f"s{seed}", ts, k, x, None, rng.random() < 0.1, False, 1))
        if ts // 180_000 != (ts - 7_000) // 180_000:
            out.append((f"s{seed}", ts // 180_000 * 180_000, 0, x, rng.choice([0.0, 2.0, 5.0]), False, True, 0))
    return out


SCHEMA = "symbol string, ts_ms long, seq long, price double, atr double, fires boolean, is_close boolean, is_trade int"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows_of(1) + rows_of(2), SCHEMA)
    closes, trades = df.where("is_close").select("symbol", "ts_ms", "price", "atr"), df.where("NOT is_close").select("symbol", "ts_ms", "seq", "price", "fires")
    batch = sorted(map(tuple, op.intrabar_looks(closes, trades).collect()))
    assert len(batch) > 30 and {r[5] for r in batch} == {"move", "time"} and any(r[6] for r in batch)
    whole = op.asked(closes, trades)
    step = 600 * 7_000 // 4
    for k in range(5):
        start = 20 * DAY - 41 * 60_000 + k * step
        whole.where(f"ts_ms >= {start} AND ts_ms < {start + step}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = look_stream(stream).writeStream.format("memory").queryName("look_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert sorted(map(tuple, spark.table("look_stream").collect())) == batch
    finally:
        spark.conf.set(key, before)


def test_freshness(spark):
    bars = spark.createDataFrame([("s", DAY + 100_000), ("s", DAY + 700_000), ("s", 2 * DAY)], "symbol string, ts_ms long")
    arrivals = spark.createDataFrame([("s", "a", DAY - 5), ("s", "a", DAY + 50_000), ("s", "b", DAY + 100_000), ("s", "b", DAY + 650_000), ("t", "a", DAY + 99_000)], "symbol string, source string, ts_ms long")
    got = [tuple(r) for r in op.freshness(bars, arrivals, ["a", "b"], weights={"b": 2}).orderBy("ts_ms").collect()]
    assert got == [
        ("s", DAY + 100_000, 50_000, 0, "50s", "0s", 3, 3),
        ("s", DAY + 700_000, 650_000, 50_000, "10m50s", "50s", 2, 3),
        ("s", 2 * DAY, None, None, "never", "never", 0, 3),
    ]


def files(path, part):
    folder = f"{path}/day={part}"
    return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}


def test_patches_write_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k, k // 10, float(k), f"x{k}") for k in range(30)]
    sinks.patch_in_place(spark, path, spark.createDataFrame(rows, "id long, day int, price double, note string").repartition(5), ["id"], "day")
    assert len(files(path, 0)) == 1  # one file a folder, whatever wrote it
    before = {d: files(path, d) for d in range(3)}
    changes = spark.createDataFrame([(12, 1, -1.0), (99, 1, -2.0)], "id long, day int, price double")
    sinks.patch_in_place(spark, path, changes, ["id"], "day")
    assert files(path, 0) == before[0] and files(path, 2) == before[2] and files(path, 1) != before[1]
    table = {r.id: (r.price, r.note, r.version) for r in spark.read.parquet(path).collect()}
    assert len(table) == 31 and table[12] == (-1.0, "x12", 2) and table[99] == (-2.0, None, 1) and table[13] == (13.0, "x13", 1)
    sinks.patch_in_place(spark, path, changes.withColumn("id", F.col("id") + 200), ["id"], "day", insert=False)
    assert spark.read.parquet(path).count() == 31
    assert [f for f in os.listdir(tmp_path) if "stage" in f] == []


def test_patches_check_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.patch_in_place(spark, path, spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, "c")], "id long, day int, state string"), ["id"], "day")
    change = lambda rows: spark.createDataFrame(rows, "id long, day int, state string, version long")
    sinks.patch_in_place(spark, path, change([(1, 0, "x", 1), (9, 0, "n", None)]), ["id"], "day")
    for bad in ([(1, 0, "y", 1)], [(2, 0, "y", None)], [(50, 0, "y", 1)], [(3, 1, "y", 1), (1, 0, "y", 3)]):
        with pytest.raises(sinks.Conflict):
            sinks.patch_in_place(spark, path, change(bad), ["id"], "day")
    assert sorted((r.id, r.state, r.version) for r in spark.read.parquet(path).collect()) == [(1, "x", 2), (2, "b", 1), (3, "c", 1), (9, "n", 1)]
