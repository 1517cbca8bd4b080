"""Registered queries: bars, footprints, scalar rules and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks, scalars, units
from ..functions.clocks import DAY, HOUR
from ..operators import bars as op
from ..operators import joins
from ..sources.sinks import latest
from ..sources.trades import trades
from .base import STEP, WIDE, B, T, bars_sql, hourly, rounded

FOUR = 4 * HOUR
FOOT = f"""{T}, f AS (
  SELECT symbol, ts_ms - ts_ms % {DAY} AS bucket, (price_units + {WIDE // 2}) // {WIDE} * {WIDE} AS level,
         CAST(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END) AS BIGINT) AS buy_qty, CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty,
         count(*) FILTER (NOT is_sell) AS n_buys, count(*) FILTER (is_sell) AS n_sells, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
  FROM t GROUP BY 1, 2, 3
)"""


def cells(spark, sf_dir):
    return op.footprint(trades(spark, sf_dir), DAY, WIDE)


def scalar_units(spark, sf_dir):
    u = F.col("price_units") - 25_000_000_000  # both signs
    return trades(spark, sf_dir).select(
        "seq", units.round_to_step(u, WIDE).alias("nearest"), units.floor_to_step(u, WIDE).alias("down"), units.ceil_to_step(u, WIDE).alias("up"),
        units.round_to_side_step(u, F.col("is_sell"), WIDE).alias("by_side"), units.steps_between(F.lit(0), F.col("price_units"), WIDE).alias("steps"),
        units.lots(F.col("qty") - 50, 7).alias("lots"), units.floor_time(F.col("ts_ms"), HOUR).alias("hour_ms"), units.offset_time(F.col("ts_ms"), HOUR, -3).alias("back_ms"),
    )


def scalar_clocks(spark, sf_dir):
    ts = F.col("ts_ms")
    return trades(spark, sf_dir).select(
        "seq", clocks.region(ts).alias("region"), clocks.kill_zone(ts).alias("zone"), clocks.weekday(ts).alias("weekday"), clocks.week_start(ts).cast("long").alias("week_ms"),
        *[clocks.in_session(ts, s).alias(f"in_{s}") for s in clocks.SESSIONS],
    )


def scalar_rules(spark, sf_dir):
    p, rate = F.col("price"), F.when(F.col("qty") % 5 != 0, (F.col("qty") - 50) / 20000.0)
    basis = (F.col("qty") - 50) / 50.0
    return rounded(
        trades(spark, sf_dir).select(
            "seq", scalars.price_relation(p, F.when(F.col("qty") % 3 != 0, F.lit(20.0))).alias("relation"), scalars.value_location(p, F.lit(40.0), F.lit(10.0)).alias("location"),
            scalars.funding_long_ok(rate).alias("long_ok"), scalars.funding_short_ok(rate).alias("short_ok"), scalars.basis_ok(basis, F.col("is_sell")).alias("basis_ok"),
            scalars.ramp(p, 5.0, 45.0).alias("ramp"), scalars.slippage_entry(p, F.col("is_sell"), 5.0).alias("entry"), scalars.slippage_exit(p, F.col("is_sell"), 5.0).alias("exit"),
            scalars.first_reason((p < 60, "price"), (F.col("qty") > 10, "size"), (rate < 0.002, "funding")).alias("reason"),
            scalars.imbalance(F.col("qty"), F.col("seq") % 50).alias("imbalance"),
        ),
        "ramp", "entry", "exit", "imbalance",
    )


def naked(spark, sf_dir):
    days = op.time_bars(trades(spark, sf_dir), DAY)
    return op.poc_status(op.points_of_control(cells(spark, sf_dir)), days, WIDE)


def as_of_purchase(spark, sf_dir):
    t = trades(spark, sf_dir)
    right = t.where("symbol = 'purchase'").select(F.lit("all").alias("k"), "ts_ms", F.col("price").alias("p_price"), F.col("seq").alias("p_seq"))
    return joins.as_of(t.where("symbol <> 'purchase'").select(F.lit("all").alias("k"), "ts_ms", "seq"), right, "k", "ts_ms", ["p_price", "p_seq"], tie=["p_seq"]).select("seq", "p_price", "p_seq")


def band_pairs(spark, sf_dir):
    t = trades(spark, sf_dir)
    a = t.where("symbol = 'error'").select(F.lit(1).alias("k"), F.col("ts_ms").alias("ta"), F.col("seq").alias("a"))
    b = t.where("symbol = 'purchase'").select(F.lit(1).alias("k"), F.col("ts_ms").alias("tb"), F.col("seq").alias("b"))
    return joins.band(a, b, "k", "ta", "tb", 600_000).select("a", "b", (F.col("tb") - F.col("ta")).alias("dt"))


def first_hits(spark, sf_dir):
    from .base import numbered_bars

    b = numbered_bars(spark, sf_dir)
    s = b.select("symbol", "n", F.col("close").alias("entry"), (F.col("close") * 0.5).alias("stop"), (F.col("close") * 2).alias("target"))
    return rounded(joins.first_hit(s, b, 12).select("symbol", "n", "outcome", "hit_n", "r"), "r")


def upserted(spark, sf_dir):
    c = trades(spark, sf_dir).select("symbol", (F.col("ts_ms") - F.col("ts_ms") % DAY).alias("bucket"), "price", "qty", "seq")
    return op.upsert(c, ["symbol", "bucket"], F.col("seq")).select("symbol", "bucket", "price", "qty", "seq")


def existing(spark, sf_dir):
    t = trades(spark, sf_dir)
    return op.existing_bars_only(t, op.time_bars(t, HOUR).where("n_trades >= 4"), HOUR)


def depth_overlap(spark, sf_dir):
    runs = trades(spark, sf_dir).select(units.floor_to_step(F.col("price_units"), WIDE).alias("level"), F.col("ts_ms").alias("start"), (F.col("ts_ms") + F.col("qty") * 60_000).alias("until"), "qty", "seq")
    return joins.grid_cells(joins.overlapping(runs, 0, 1 << 60), HOUR)


QUERIES = {
    "bars_hourly": (hourly, f"WITH {B} SELECT * FROM b"),
    "bars_first_trade": (
        lambda s, d: op.first_trade_bars(trades(s, d), HOUR),
        f"WITH {B} SELECT symbol, bucket, open AS price, buy_qty, sell_qty FROM b",
    ),
    "bars_existing_only": (existing, f"WITH {B} SELECT symbol, bucket, buy_qty, sell_qty FROM b WHERE n_trades >= 4"),
    "bars_ticks": (
        lambda s, d: op.tick_bars(trades(s, d), 50),
        f"""WITH {T}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq) - 1) // 50 AS bar FROM t)
SELECT symbol, bar, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts_ms, seq) AS close, CAST(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END) AS BIGINT) AS buy_qty,
       CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty, count(*) AS n_trades FROM k GROUP BY 1, 2""",
    ),
    "bars_upsert": (upserted, f"""WITH {T} SELECT symbol, ts_ms - ts_ms % {DAY} AS bucket, arg_max(price, seq) AS price, arg_max(qty, seq) AS qty, max(seq) AS seq FROM t GROUP BY 1, 2"""),
    "bars_resampled": (
        lambda s, d: op.resample(hourly(s, d), FOUR),
        f"""WITH {B} SELECT symbol, bucket - bucket % {FOUR} AS bucket, first(open ORDER BY bucket) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bucket) AS close,
CAST(sum(buy_qty) AS BIGINT) AS buy_qty, CAST(sum(sell_qty) AS BIGINT) AS sell_qty, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n_trades) AS BIGINT) AS n_trades, CAST(sum(delta) AS BIGINT) AS delta
FROM b GROUP BY symbol, b.bucket - b.bucket % {FOUR} HAVING sum(volume) > 0""",
    ),
    "bars_missing": (
        lambda s, d: op.missing_buckets(hourly(s, d), HOUR).select("symbol", "bucket"),
        f"""WITH {B}, e AS (SELECT symbol, unnest(range(min(bucket), max(bucket) + 1, {HOUR})) AS bucket FROM b GROUP BY symbol)
SELECT e.symbol, e.bucket FROM e ANTI JOIN b USING (symbol, bucket)""",
    ),
    "footprint_nearest": (cells, f"WITH {FOOT} SELECT * FROM f"),
    "footprint_by_side": (
        lambda s, d: op.footprint(trades(s, d), DAY, WIDE, by_side=True).select("symbol", "bucket", "level", "buy_qty", "sell_qty"),
        f"""WITH {T} SELECT symbol, ts_ms - ts_ms % {DAY} AS bucket,
CASE WHEN is_sell THEN price_units // {WIDE} * {WIDE} ELSE (price_units + {WIDE - 1}) // {WIDE} * {WIDE} END AS level,
CAST(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END) AS BIGINT) AS buy_qty, CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty FROM t GROUP BY 1, 2, 3""",
    ),
    "footprint_clusters": (
        lambda s, d: cells(s, d).select("symbol", "bucket", "level", *[op.cluster(k).alias(k) for k in ("bid_ask", "delta", "volume")]),
        f"WITH {FOOT} SELECT symbol, bucket, level, greatest(buy_qty, sell_qty) AS bid_ask, abs(buy_qty - sell_qty) AS delta, buy_qty + sell_qty AS volume FROM f",
    ),
    "footprint_poc": (
        lambda s, d: op.points_of_control(cells(s, d)),
        f"WITH {FOOT} SELECT symbol, bucket, first(level ORDER BY buy_qty + sell_qty DESC, level) AS poc, max(buy_qty + sell_qty) AS poc_qty FROM f GROUP BY 1, 2",
    ),
    "footprint_naked_poc": (
        naked,
        f"""WITH {FOOT}, {bars_sql('d', DAY)},
p AS (SELECT symbol, bucket, first(level ORDER BY buy_qty + sell_qty DESC, level) AS poc, max(buy_qty + sell_qty) AS poc_qty FROM f GROUP BY 1, 2),
l AS (SELECT symbol, bucket, (CAST(round(low * 100000000) AS BIGINT) + {WIDE // 2}) // {WIDE} * {WIDE} AS lo, (CAST(round(high * 100000000) AS BIGINT) + {WIDE // 2}) // {WIDE} * {WIDE} AS hi FROM d),
h AS (SELECT p.symbol, p.bucket, min(l.bucket) AS filled_at FROM p JOIN l ON p.symbol = l.symbol AND l.bucket > p.bucket AND p.poc BETWEEN l.lo AND l.hi GROUP BY 1, 2)
SELECT p.*, h.filled_at, CASE WHEN filled_at IS NOT NULL THEN 'filled' WHEN p.bucket < (SELECT max(bucket) FROM d WHERE d.symbol = p.symbol) THEN 'naked' ELSE 'none' END AS status
FROM p LEFT JOIN h USING (symbol, bucket)""",
    ),
    "footprint_diagonal": (
        lambda s, d: op.diagonal_imbalances(cells(s, d), WIDE, 200),
        f"""WITH {FOOT} SELECT a.symbol, a.bucket, a.level, a.sell_qty, c.buy_qty AS buy_above,
CASE WHEN a.sell_qty > 0 AND c.buy_qty * 100 > a.sell_qty * 300 THEN 'buy' ELSE 'sell' END AS side
FROM f a JOIN f c ON a.symbol = c.symbol AND a.bucket = c.bucket AND c.level = a.level + {WIDE}
WHERE (a.sell_qty > 0 AND c.buy_qty * 100 > a.sell_qty * 300) OR (c.buy_qty > 0 AND a.sell_qty * 100 > c.buy_qty * 300)""",
    ),
    "footprint_auction_ends": (
        lambda s, d: op.auction_ends(cells(s, d)),
        f"""WITH {FOOT}, e AS (SELECT symbol, bucket, count(*) AS levels, min(level) AS low_level, max(level) AS high_level FROM f GROUP BY 1, 2)
SELECT e.*, l.buy_qty > 0 AND l.sell_qty > 0 AS unfinished_low, h.buy_qty > 0 AND h.sell_qty > 0 AS unfinished_high
FROM e JOIN f l ON l.symbol = e.symbol AND l.bucket = e.bucket AND l.level = low_level JOIN f h ON h.symbol = e.symbol AND h.bucket = e.bucket AND h.level = high_level""",
    ),
    "tape": (
        lambda s, d: rounded(op.tape(trades(s, d), DAY), "count_share", "volume_share"),
        f"""WITH {T}, g AS (SELECT symbol, ts_ms - ts_ms % {DAY} AS bucket, count(*) FILTER (NOT is_sell) AS n_buys, count(*) FILTER (is_sell) AS n_sells,
CAST(sum(CASE WHEN NOT is_sell THEN qty ELSE 0 END) AS BIGINT) AS buy_qty, CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty FROM t GROUP BY 1, 2)
SELECT *, round(n_buys / nullif(n_buys + n_sells, 0), 6) AS count_share, round(buy_qty / nullif(buy_qty + sell_qty, 0), 6) AS volume_share,
CAST(round(buy_qty / nullif(n_buys, 0)) AS BIGINT) AS avg_buy, CAST(round(sell_qty / nullif(n_sells, 0)) AS BIGINT) AS avg_sell FROM g""",
    ),
    "scalar_units": (
        scalar_units,
        f"""WITH {T}, u AS (SELECT *, price_units - 25000000000 AS u, qty - 50 AS q FROM t),
m AS (SELECT *, ((u % {WIDE}) + {WIDE}) % {WIDE} AS m, (((u + {WIDE // 2}) % {WIDE}) + {WIDE}) % {WIDE} AS h FROM u)
SELECT seq, u + {WIDE // 2} - h AS nearest, u - m AS down, CASE WHEN m = 0 THEN u ELSE u - m + {WIDE} END AS up,
CASE WHEN is_sell OR m = 0 THEN u - m ELSE u - m + {WIDE} END AS by_side, price_units // {WIDE} + 1 AS steps,
CASE WHEN q >= 0 THEN (q + 3) // 7 ELSE -((-q + 3) // 7) END AS lots, ts_ms - ts_ms % {HOUR} AS hour_ms, ts_ms - {3 * HOUR} AS back_ms FROM m""",
    ),
    "scalar_clocks": (
        scalar_clocks,
        f"""WITH {T}, c AS (SELECT seq, ts_ms // {DAY} AS d, ts_ms % {DAY} // 60000 AS m FROM t)
SELECT seq, CASE WHEN m >= 780 AND m < 960 THEN 'overlap' WHEN m >= 780 AND m < 1260 THEN 'new_york' WHEN m >= 480 AND m < 960 THEN 'london' WHEN m < 480 THEN 'asia' ELSE 'off_hours' END AS region,
CASE WHEN m < 120 THEN 'asia' WHEN m < 300 THEN 'london_zone' WHEN m < 420 THEN 'london' WHEN m < 600 THEN 'new_york_zone' WHEN m < 1200 THEN 'new_york' ELSE 'off' END AS zone,
CAST((d + 3) % 7 AS INTEGER) AS weekday, (d - (d + 3) % 7) * {DAY} AS week_ms, m < 480 AS in_asia, m >= 480 AND m < 960 AS in_london, m >= 780 AND m < 1260 AS in_new_york FROM c""",
    ),
    "scalar_rules": (
        scalar_rules,
        f"""WITH {T}, x AS (SELECT *, CASE WHEN qty % 5 <> 0 THEN (qty - 50) / 20000.0::DOUBLE END AS rate, (qty - 50) / 50.0::DOUBLE AS basis FROM t)
SELECT seq, CASE WHEN qty % 3 = 0 THEN 'unknown' WHEN price > 20 THEN 'above' WHEN price < 20 THEN 'below' ELSE 'at' END AS relation,
CASE WHEN price > 40 THEN 'above_value' WHEN price < 10 THEN 'below_value' ELSE 'in_value' END AS location,
coalesce(rate < 0.0008::DOUBLE, true) AS long_ok, coalesce(rate > -0.0005::DOUBLE, true) AS short_ok, CASE WHEN is_sell THEN basis < 0.5 ELSE basis > -0.5 END AS basis_ok,
round(greatest(0.0, least(1.0, (price - 5) / 40)), 6) AS ramp, round(price * CASE WHEN is_sell THEN 1.0005 ELSE 0.9995 END::DOUBLE, 6) AS entry,
round(price * CASE WHEN is_sell THEN 0.9995 ELSE 1.0005 END::DOUBLE, 6) AS exit,
CASE WHEN price >= 60 THEN 'price' WHEN qty <= 10 THEN 'size' WHEN rate IS NULL OR rate >= 0.002::DOUBLE THEN 'funding' END AS reason,
round(coalesce((qty - seq % 50) / nullif(qty + seq % 50, 0), 0), 6) AS imbalance FROM x""",
    ),
    "join_as_of": (
        as_of_purchase,
        f"""WITH {T}, r AS (SELECT ts_ms, price AS p_price, seq AS p_seq FROM t WHERE symbol = 'purchase')
SELECT l.seq, r.p_price, r.p_seq FROM (SELECT * FROM t WHERE symbol <> 'purchase') l ASOF LEFT JOIN r ON l.ts_ms >= r.ts_ms""",
    ),
    "join_previous_wide_bar": (
        lambda s, d: joins.previous_bar(hourly(s, d).select("symbol", "bucket"), op.resample(hourly(s, d), FOUR), FOUR, ["close", "delta"]),
        f"""WITH {B}, w AS (SELECT symbol, bucket - bucket % {FOUR} AS wide, last(close ORDER BY bucket) AS close, CAST(sum(delta) AS BIGINT) AS delta FROM b GROUP BY 1, 2 HAVING sum(volume) > 0),
p AS (SELECT symbol, wide, lag(close) OVER x AS prev_close, lag(delta) OVER x AS prev_delta FROM w WINDOW x AS (PARTITION BY symbol ORDER BY wide))
SELECT b.symbol, b.bucket, p.prev_close, p.prev_delta FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.wide = b.bucket - b.bucket % {FOUR}""",
    ),
    "join_band": (
        band_pairs,
        f"WITH {T} SELECT a.seq AS a, b.seq AS b, b.ts_ms - a.ts_ms AS dt FROM t a JOIN t b ON a.symbol = 'error' AND b.symbol = 'purchase' AND abs(a.ts_ms - b.ts_ms) <= 600000",
    ),
    "join_first_hit": (
        first_hits,
        f"""WITH {B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS n FROM b),
s AS (SELECT symbol, n, close AS entry, close * 0.5::DOUBLE AS stop, close * 2 AS target FROM n),
m AS (SELECT s.*, l.n AS m, l.close AS c, CASE WHEN l.low <= stop THEN 'stop' WHEN l.high >= target THEN 'target' END AS hit FROM s JOIN n l ON l.symbol = s.symbol AND l.n BETWEEN s.n + 1 AND s.n + 12),
g AS (SELECT symbol, n, entry, stop, target, first(hit ORDER BY m) FILTER (hit IS NOT NULL) AS hit, CAST(min(m) FILTER (hit IS NOT NULL) AS INTEGER) AS hit_n, last(c ORDER BY m) AS c FROM m GROUP BY ALL)
SELECT symbol, CAST(n AS INTEGER) AS n, coalesce(hit, 'timeout') AS outcome, hit_n, round(CASE hit WHEN 'stop' THEN -1 WHEN 'target' THEN (target - entry) / (entry - stop) ELSE (c - entry) / (entry - stop) END, 6) AS r FROM g""",
    ),
    "join_interval_grid": (
        depth_overlap,
        f"""WITH {T}, r AS (SELECT price_units // {WIDE} * {WIDE} AS level, ts_ms AS start, ts_ms + qty * 60000 AS until, qty FROM t),
g AS (SELECT *, unnest(range(CAST(ceil(start / {HOUR}) AS BIGINT) * {HOUR}, until, {HOUR})) AS t FROM r)
SELECT t, level, first(qty ORDER BY start, qty) AS qty FROM g GROUP BY 1, 2""",
    ),
    "latest_by_key": (
        lambda s, d: latest(trades(s, d).select("symbol", "is_sell", "ts_ms", "seq", "price"), ["symbol", "is_sell"], ["ts_ms", "seq"]),
        f"WITH {T} SELECT DISTINCT ON (symbol, is_sell) symbol, is_sell, ts_ms, seq, price FROM t ORDER BY symbol, is_sell, ts_ms DESC, seq DESC",
    ),
}
