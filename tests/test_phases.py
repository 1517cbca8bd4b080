"""The phase machine: on cases that must and must not signal, in a stream as in a batch."""

from __future__ import annotations

import random

import pytest

from marketloom.operators import phases
from marketloom.operators.phases import Phases, Rules, nearest_target
from marketloom.streaming.phases import phase_stream

BARS = "symbol string, bucket long, high double, low double, close double, volume double, delta double, vpin double, session_cvd double, naked array<double>, absorbed_bid boolean, absorbed_ask boolean, trend string"


def bar(k, close=60_000.0, volume=100.0, delta=0.0, half=20.0, **more):
    return {"symbol": "s", "bucket": k * 60_000, "high": close + half, "low": close - half, "close": close, "volume": volume, "delta": delta} | more


def warmed(n=60, rules=None):
    """A machine that has seen quiet bars, of a range of 40 dollars, enough for its range to be on."""
    m = Phases("s", rules or Rules())
    for k in range(n):
        assert m.step(bar(k)) is None
    return m


def test_nothing_before_the_warmup():
    m = Phases("s", Rules())
    assert m.step(bar(0, 95.0, 200.0, -50.0)) is None and m.stage == "idle"


def test_range_widens_and_ends():
    m = warmed(61)
    assert m.stage == "range" and (m.high, m.low, m.bars) == (60_020.0, 59_980.0, 16)
    m.step(bar(61, 60_010.0, absorbed_bid=True, delta=3.0))
    assert (m.high, m.low, m.bars, m.absorbed_bars, m.cvd) == (60_030.0, 59_980.0, 17, 1, 3.0)
    m.step(bar(62, 60_000.0, half=200.0))  # wider than 0.45 %
    assert m.stage == "idle"
    m = warmed(60 + 35)
    assert m.stage == "range" and m.bars == 50
    m.step(bar(95))
    assert m.stage == "idle"  # a range of more than 50 bars


def test_range_at_the_edge_of_the_band():
    m = Phases("s", Rules())
    for k in range(61):
        m.step(bar(k, half=17.9))  # 0.0597 %
    assert m.stage == "idle"


def broken(delta=-40.0, volume=400.0, **more):
    m = warmed(64)
    m.step(bar(64, 60_100.0, volume, delta, **more))
    return m


@pytest.mark.parametrize(
    ("given", "stage"),
    [
        ({}, "break"),
        ({"delta": 40.0}, "idle"),
        ({"delta": 40.0, "vpin": 0.61}, "break"),
        ({"delta": 0.0}, "idle"),
        ({"volume": 150.0}, "idle"),
        ({"liquidation": 1_000.0}, "idle"),
    ],
)
def test_break_needs_volume_and_doubt(given, stage):
    assert broken(**given).stage == stage


def test_turn_after_a_false_break():
    m = broken(session_cvd=-20.0, ask_wall=False)
    assert m.step(bar(65, 60_060.0, 500.0)) is None and m.stage == "break"  # still outside
    assert m.step(bar(66, 60_000.0, 100.0)) is None  # without volume
    s = m.step(bar(67, 59_990.0, 500.0, -30.0, session_cvd=-20.0, trend="Bear", naked=[59_500.0, 60_500.0], thin=[59_950.0]))
    assert (s["side"], s["range_high"], s["range_bars"], s["extreme"], s["bars_to_turn"]) == ("short", 60_020.0, 19, 60_120.0, 3)
    assert s["stop"] == 60_120.0 * 1.0008 and (s["target"], s["source"]) == (59_500.0, "naked")
    # delta against the break 2, volume 3 times 2, calm liquidations 1, session against it 1
    assert s["quality"] == 6 and s["with_trend"] and s["zone"] == "" and s["reward"] > 2
    assert m.stage == "idle" and m.signalled == m.seen
    for k in range(68, 68 + 44):
        m.step(bar(k))
        assert m.stage == "idle"  # rests after a signal


def test_turn_waits_six_bars():
    m = broken()
    for k in range(6):
        m.step(bar(65 + k, 60_100.0))
        assert m.stage == "break"
    m.step(bar(71, 60_000.0, 900.0))
    assert m.stage == "idle" and m.signalled == 0


def test_mirrored_bars_give_the_mirrored_signal():
    up, down = warmed(64), warmed(64)
    for k, (close, volume, delta) in enumerate([(60_100.0, 400.0, -40.0), (60_000.0, 500.0, -5.0)]):
        a = up.step(bar(64 + k, close, volume, delta, naked=[59_000.0]))
        b = down.step(bar(64 + k, 120_000.0 - close, volume, -delta, naked=[61_000.0]))
    assert (a["side"], b["side"]) == ("short", "long") and a["quality"] == b["quality"] and a["reward"] == pytest.approx(b["reward"], rel=1e-2)


def test_nearest_target():
    assert nearest_target(-1, 60_000.0, 200.0, []) == (59_600.0, "two_risks")
    assert nearest_target(-1, 60_000.0, 200.0, [("thin", [59_500.0])]) == (59_500.0, "thin")
    assert nearest_target(-1, 60_000.0, 200.0, [("thin", [59_200.0]), ("naked", [59_700.0])]) == (59_700.0, "naked")
    assert nearest_target(1, 60_000.0, 200.0, [("thin", [60_100.0, 60_200.0]), ("naked", [60_200.0]), ("value", [None])]) == (60_200.0, "thin")


def walk(seed, n=700):
    """Quiet stretches with breaks that fail, and some that do not."""
    rng, out, mid = random.Random(seed), [], 60_000.0
    for k in range(n):
        loud = rng.random() < 0.04
        close = mid + rng.choice([-110, 110]) * loud + rng.uniform(-15, 15)
        mid += rng.uniform(-4, 4)
        volume, delta = rng.uniform(80, 120) * (4 if loud or (out and out[-1][5] > 200) else 1), rng.uniform(-40, 40)
        out.append((f"s{seed}", k * 60_000, close + rng.uniform(1, 15), close - rng.uniform(1, 15), close, volume, delta, rng.choice([None, 0.3, 0.7]), rng.uniform(-20, 20), rng.choice([None, [mid + 700, mid - 700]]), rng.random() < 0.3, rng.random() < 0.3, rng.choice([None, "Bull", "Bear"])))
    return out


def test_stream_equals_batch_and_state_survives(spark, tmp_path):
    rules = Rules(turn_volume=0.8, break_volume=1.0, cooldown=5, reward=0.5, toxic=0.2)
    rows = walk(1) + walk(2) + walk(3) + walk(4)
    df = spark.createDataFrame(rows, BARS)
    batch = sorted(map(tuple, phases.phase_signals(df, rules).collect()), key=str)
    assert len(batch) > 3 and {r[2] for r in batch} == {"long", "short"}
    for k in range(4):  # breaks and turns lie in different files
        df.where(f"bucket >= {k * 175 * 60_000} and bucket < {(k + 1) * 175 * 60_000}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = phase_stream(stream, rules).writeStream.format("memory").queryName("phase_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        assert sorted(map(tuple, spark.table("phase_stream").collect()), key=str) == batch
    finally:
        spark.conf.set(key, before)


def test_band_of_each_bar(spark):
    got = phases.in_band(spark.createDataFrame(walk(4, 60), BARS)).orderBy("bucket").collect()
    rows = walk(4, 60)
    for k, r in enumerate(got):
        part = rows[max(0, k - 14) : k + 1]
        band = (max(x[2] for x in part) - min(x[3] for x in part)) / rows[k][4] * 100
        assert r.band == pytest.approx(band) and r.in_band == (k >= 14 and 0.06 <= band <= 0.45)
