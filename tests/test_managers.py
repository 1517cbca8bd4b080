from __future__ import annotations

import pytest

from marketloom.operators import managers


def test_trail_locks_in_and_counts_the_bar_first(spark):
    t = managers.Trail(1, 0, 10.0, 9.0, 20.0, 1.2, 1.5)
    assert t.bar(11.0, 9.5) is None
    assert t.bar(13.0, 11.9) is None and t.stop == pytest.approx(11.8)
    assert t.bar(12.5, 11.7) == (pytest.approx(11.8), "trail")
    bars = spark.createDataFrame([("a", 0, 10.0, 9.9), ("a", 1, 13.0, 11.9), ("a", 2, 12.5, 11.7), ("a", 3, 12.0, 8.0)], "symbol string, bucket long, high double, low double")
    s = spark.createDataFrame([("a", 0, "long", 10.0, 9.0, 20.0), ("a", 2, "short", 11.0, 10.5, 9.0)], "symbol string, bucket long, side string, entry double, stop double, target double")
    got = managers.trailed_trades(bars, s).collect()
    assert [(r.opened, r.closed, r.reason, round(r.r, 6)) for r in got] == [(0, 2, "trail", 1.8)]


def test_limit_orders_fill_beyond_the_margin_and_expire(spark):
    o = spark.createDataFrame([("a", 1, 0, 10.0), ("a", 2, 1, 10.5), ("a", 3, 2, 15.0), ("a", 4, 50, 5.0)], "symbol string, order_id long, ts_ms long, price double")
    t = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 6, 2, 9.98), ("a", 200, 3, 1.0)], "symbol string, ts_ms long, seq long, price double")
    got = managers.limit_fills(o, t, 10, 100, 2.0).collect()
    assert sorted((r.order_id, r.filled) for r in got) == [(1, 6), (3, 5)]


def test_vanished_orders_are_large_near_and_short(spark):
    rows = [("a", 0, 0, 10.0, 60.0), ("a", 100, 1, 10.0, 0.0), ("a", 200, 2, 10.0, 60.0), ("a", 900, 3, 10.0, 0.0), ("a", 901, 4, 11.0, 60.0), ("a", 902, 5, 11.0, 0.0)]
    u = spark.createDataFrame([(*r, 10.0, 10.0) for r in rows], "symbol string, ts_ms long, seq long, price double, qty double, mid double, mean_qty double")
    assert [(r.price, r.seen_ms, r.gone_ms) for r in managers.vanished_orders(u).collect()] == [(10.0, 0, 100)]


def test_chases_and_averages(spark):
    q = spark.createDataFrame([("a", i, i, p) for i, p in enumerate((1.0, 2.0, 3.0, 4.0, 4.0, 3.5, 3.0))], "symbol string, ts_ms long, seq long, price double")
    assert [r.state for r in managers.chases(q).orderBy("seq").collect()] == ["idle", "idle", "idle", "chasing", "chasing", "fading", "fading"]
    s = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, -1.0)], "symbol string, ts_ms long, seq long, imbalance double")
    assert [round(r.fast, 6) for r in managers.imbalance_averages(s).orderBy("seq").collect()] == [0.55, 0.495]
