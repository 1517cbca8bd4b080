"""Books in archives and the search for the first crossing, against plain loops."""

from __future__ import annotations

import itertools
import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import depth, search
from marketloom.operators.depth import Book
from marketloom.sources import archives
from marketloom.sources.trades import read_book_json

DAY = 86_400_000
START = 1_704_067_200_000


def message(k, ts, symbol="s", kind="delta", b=(), a=(), u=True):
    data = {"s": symbol, "b": [[str(p), str(q)] for p, q in b], "a": [[str(p), str(q)] for p, q in a]} | ({"u": k} if u else {})
    return json.dumps({"type": kind, "ts": ts, "data": data})


@pytest.fixture
def archived(tmp_path):
    """Three days in two archives, among them lines that are no messages."""
    at = tmp_path / "books/deep"
    at.mkdir(parents=True)
    days = [[message(k, START + d * DAY + k, kind="snapshot" if k == 0 else "delta", b=[(10.5, k)], a=[(11, k + 1), (12, 1)]) for k in range(50)] for d in range(3)]
    days[1][10:10] = ["no json", "", '{"type": "other", "ts": 1}', '{"type": "delta"}', "[1]"]
    with zipfile.ZipFile(at / "first.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("2024-01-01_s.data", "\n".join(days[0]))
        z.writestr("2024-01-02_s.data", "\n".join(days[1]) + "\n")
    with zipfile.ZipFile(at / "2024-01-03_x.zip", "w") as z:
        z.writestr("folder/2024-01-03_s.data", "\r\n".join(days[2]))
        z.writestr("empty.data", "")
    for d, rows in enumerate(days):
        (tmp_path / f"plain-{d}").write_text("\n".join(r for r in rows if r and r != "[1]"))
    return tmp_path


def test_archives_equal_plain_lines(spark, archived):
    found = archives.read_book_archives(spark, str(archived / "books"))
    assert found.rdd.getNumPartitions() == 4
    plain = read_book_json(spark, str(archived / "plain-*")).where("ts_ms IS NOT NULL")
    key = lambda df: sorted(map(tuple, df.select("symbol", "ts_ms", "seq", "type", "b", "a").collect()))
    assert key(found) == key(plain) and found.count() == 150


def test_a_single_archive_and_chosen_columns(spark, archived):
    found = archives.read_book_archives(spark, f"file://{archived}/books/deep/first.zip", columns=["ts_ms", "seq"])
    assert found.columns == ["ts_ms", "seq"] and found.count() == 100


def test_members_of_other_days_are_not_opened(archived):
    options = {"path": str(archived / "books"), "start_ms": str(START + DAY + 5), "end_ms": str(START + DAY + 20)}
    reader = archives.BookArchiveReader(options, ["ts_ms"])
    parts = reader.partitions()
    assert [p.name for p in parts] == ["2024-01-02_s.data"]  # the archive of the third day is not opened, a member without a date lies in it
    assert [t for p in parts for b in reader.read(p) for t in b["ts_ms"].to_pylist()] == list(range(START + DAY + 5, START + DAY + 20))
    assert archives.day_of("a/20240229.zip") == 1_709_164_800_000 and archives.day_of("2024-13-01.zip") is None and archives.day_of("x.zip") is None


def test_a_member_is_streamed(tmp_path, monkeypatch):
    """The first messages of a large member come before the rest of it is read."""
    path = tmp_path / "2024-01-01_big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("2024-01-01_s.data", "w") as member:
        for k in range(60_000):
            member.write((message(k, START + k, b=[(10.5, k)] * 5) + "\n").encode())
    read = [0]
    plain = zipfile.ZipExtFile.read

    def counted(self, n=-1):
        out = plain(self, n)
        read[0] += len(out)
        return out

    monkeypatch.setattr(zipfile.ZipExtFile, "read", counted)
    reader = archives.BookArchiveReader({"path": str(path)}, ["seq"])
    batches = reader.read(reader.partitions()[0])
    assert next(batches).num_rows == archives.BATCH and read[0] <= 2 * archives.AHEAD
    assert archives.BATCH + sum(b.num_rows for b in batches) == 60_000 and read[0] > 5_000_000


def test_written_archives_read_back(spark, tmp_path):
    rows = [(s, START + d * DAY + k, k, message(k, START + d * DAY + k, s, "snapshot" if k == 0 else "delta", b=[(1, k)])) for s in "ab" for d in range(2) for k in range(5)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, value string")
    assert sorted(r[0] for r in archives.write_book_archives(df, f"file://{tmp_path}/out").collect()) == [f"2024-01-0{d}_{s}.data" for d in (1, 2) for s in "ab"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2024-01-01_books.zip", "2024-01-02_books.zip"]
    assert archives.read_book_archives(spark, str(tmp_path / "out")).count() == 20


def test_a_deep_book_replays_without_sorting_it():
    """20,000 messages on sides of 10,000 levels: sorting a side at each took over a minute."""
    book, rng, began = Book(), random.Random(3), time.process_time()
    book.apply(0, "snapshot", [(k / 100, 1.0) for k in range(10_000)], [(1000 + k / 100, 1.0) for k in range(10_000)])
    for k in range(20_000):
        book.apply(k, "delta", [(rng.randrange(10_000) / 100, float(rng.randrange(3)))], [(1000 + rng.randrange(10_000) / 100, float(rng.randrange(3)))])
        bids, asks = book.top(25)
    assert time.process_time() - began < 10
    assert bids == sorted(book.bids.items(), reverse=True)[:25] and asks == sorted(book.asks.items())[:25]


def test_samples_of_slots_are_the_last_ones(spark):
    level = "array<struct<price:double,qty:double>>"
    rows = [("s", START + k // 3 * 400, k, "snapshot" if k == 0 else "delta", [(10.0 + k % 5, float(k % 4))], [(9.0 if k == 11 else 20.0 + k, 1.0)]) for k in range(40)]
    rows += [("s", START + 20_000, 99, "delta", None, [(9.0, 0.0)])]
    m = spark.createDataFrame(rows, f"symbol string, ts_ms long, seq long, type string, b {level}, a {level}")
    last = {}
    for r in depth.book_samples(m).collect():
        if r.ts_ms // 1000 not in last or (r.ts_ms, r.seq) > last[r.ts_ms // 1000][1:3]:
            last[r.ts_ms // 1000] = tuple(r)
    assert sorted(map(tuple, depth.book_samples(m, slot_ms=1000).collect())) == sorted(last.values())
    bars = depth.book_bars(depth.book_features(depth.book_samples(m)), 1000).orderBy("bucket").collect()
    assert bars[-1].mid_close == (last[bars[-1].bucket // 1000][3][0][0] + last[bars[-1].bucket // 1000][4][0][0]) / 2


@pytest.mark.parametrize("block", [1, 3, 64])
def test_first_crossing_is_that_of_a_loop(spark, block):
    rng = random.Random(block)
    series, x = [], 100.0
    for s in "ab":
        for k in range(300):
            x += rng.uniform(-2, 2)
            series.append((s, START + rng.choice([k, k - k % 3]) * 400_000, k, x))
    orders = [(k, rng.choice("abc"), START + rng.randrange(-10, 310) * 400_000 + rng.choice([0, 1]), x + rng.uniform(-30, 30), rng.random() < 0.5) for k in range(150)]
    found = search.first_crossing(spark.createDataFrame(orders, "id long, symbol string, ts_ms long, level double, below boolean"), spark.createDataFrame(series, "symbol string, ts_ms long, seq long, mid double"), "mid", block)
    got = {r.id: (r.hit_ms, r.hit_seq) for r in found.collect()}
    wanted = {}
    for k, s, ts, level, below in orders:
        hits = [(t, q) for sym, t, q, v in series if sym == s and t >= ts and t // DAY == ts // DAY and (v <= level if below else v >= level)]
        wanted[k] = min(hits, default=(None, None))
    assert got == wanted and any(h != (None, None) for h in wanted.values())


def test_no_join_of_orders_with_samples(spark):
    s = spark.createDataFrame([], "symbol string, ts_ms long, seq long, mid double")
    o = spark.createDataFrame([], "symbol string, ts_ms long, level double, below boolean")
    plan = search.first_crossing(o, s, "mid")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") >= 3


def test_entry_books(spark):
    rows = [("s", START, 0, "snapshot", [(100.0, 5.0), (90.0, 2.0), (40.0, 50.0)], [(101.0, 1.0), (110.0, 4.0), (111.0, 4.0), (200.0, 9.0)]), ("s", START + 1, 1, "delta", [(100.0, 3.0)], [])]
    m = spark.createDataFrame(rows, "symbol string, ts_ms long, seq long, type string, b array<struct<price:double,qty:double>>, a array<struct<price:double,qty:double>>")
    hits = spark.createDataFrame([(1, "s", 100.5, True, 5.0, START + 1, 1), (2, "s", 100.5, False, 5.0, START, 0), (3, "s", 150.0, True, 5.0, START, 0), (4, "s", 100.5, True, 5.0, None, None)], "id long, symbol string, entry double, is_long boolean, risk double, hit_ms long, hit_seq long")
    got = {r.id: tuple(r)[3:] for r in search.entry_books(m, hits).collect()}
    assert set(got) == {1, 2}
    assert got[1] == pytest.approx((9 / 5, abs(110 - 100.5) / 5, 4.0, 4 / 14)) and got[2] == pytest.approx((7 / 9, 0.1, 5.0, -2 / 16))


LEVEL = "array<struct<price:double,qty:double>>"


def test_orders_meet_the_book_of_a_loop(spark):
    """Days with snapshots amid them, empty and crossed books, messages of one time, levels without price and orders that nothing meets."""
    rng, rows, orders = random.Random(8), [], []
    for day, symbol in itertools.product((0, 1), "ab"):
        for k in range(250):
            side = lambda low: [(None if rng.random() < 0.02 else low + rng.randrange(12), rng.choice([0.0, None, 1.0, 2.0, 3.0])) for _ in range(rng.randrange(3))]
            kind = "snapshot" if k and rng.random() < 0.03 else "delta"
            rows.append((symbol, START + day * DAY + rng.choice([k, k - k % 3]) * 1000, k, kind, side(90.0), side(100.0)))
        orders += [(len(orders) + k, symbol, START + day * DAY + rng.randrange(-10, 260) * 1000, 98.0 + rng.randrange(8) / 2, rng.random() < 0.5, rng.choice([0.0, 1.0, 2.0])) for k in range(60)]
    m = spark.createDataFrame(rows, f"symbol string, ts_ms long, seq long, type string, b {LEVEL}, a {LEVEL}")
    o = spark.createDataFrame(orders + [(999, "c", START, 100.0, True, 1.0), (998, "a", START, None, True, 1.0)], "id long, symbol string, ts_ms long, entry double, is_long boolean, risk double")
    wanted = {}
    for id_, symbol, ts, entry, is_long, risk in orders:
        own, book, known = sorted((r for r in rows if r[0] == symbol and r[1] // DAY == ts // DAY), key=lambda r: r[1:3]), Book(), False
        for _, at, _, kind, b, a in own:
            known = known or kind == "snapshot"
            if known:
                book.apply(at, kind, *[[(p, q or 0.0) for p, q in side if p is not None] for side in (b, a)])
            bids, asks = book.best(1)
            if at < ts or not bids or not asks or bids[0] >= asks[0]:
                continue
            mid = (bids[0] + asks[0]) / 2
            if (mid <= entry if is_long else mid >= entry) and risk:
                below = [(q, -p) for p, q in book.bids.items() if entry - 3 * risk <= p <= entry]
                above = [(q, -p) for p, q in book.asks.items() if entry <= p <= entry + 3 * risk]
                if below and above:
                    ahead, behind = (above, below) if is_long else (below, above)
                    x, y = (sum(q for q, _ in side) for side in (ahead, behind))
                    wanted[id_] = (symbol, at, x / (y + 1e-9), abs(-max(ahead)[1] - entry) / risk, max(ahead)[0], (x - y) / (x + y))
            if mid <= entry if is_long else mid >= entry:
                break
    found = search.order_books(m, o)
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    assert set(got) == set(wanted) and len(got) > 30
    assert all(got[k][:2] == wanted[k][:2] and got[k][2:] == pytest.approx(wanted[k][2:]) for k in wanted)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no order met blocks of samples: they grew with the density of days
    # as by the two steps
    bid, ask = (F.get(side, F.lit(0))["price"] for side in ("bids", "asks"))
    series = depth.book_samples(m, 1).select("symbol", "ts_ms", "seq", ((bid + ask) / 2).alias("mid"))
    hits = search.first_crossing(o.withColumns({"level": F.col("entry"), "below": F.col("is_long")}), series, "mid", 16)
    assert sorted(search.entry_books(m, hits).collect()) == sorted(found.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 100])
def test_first_places_by_a_tree(n):
    rng = np.random.default_rng(n)
    values, start, below = rng.normal(size=n).round(1), rng.integers(0, n + 2, 200), rng.random(200) < 0.5
    level = rng.normal(size=200).round(1) * 2
    level[:9] = [np.nan] * 3 + [np.inf] * 3 + [-np.inf] * 3
    hit = [[j for j in range(i, n) if (values[j] <= x if b else values[j] >= x)] for i, x, b in zip(start, level, below, strict=True)]
    assert search.first_at_or_beyond(values, start, level, below).tolist() == [h[0] if h else -1 for h in hit]
