"""Registered queries: order flow, levels and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, HOUR, MINUTE
from ..operators import bars as bar_op
from ..operators import flow as op
from ..operators import profile, structure
from ..sources.trades import trades
from .bars import FOOT, cells
from .base import STEP, B, N, T, bars_sql, hourly, numbered_bars, rounded
from .indicators import ALL, ORDER, PROFILE, back, before

START = 1_704_067_200_000


def anchored(s, d):
    b = hourly(s, d)
    b = op.anchored_vwap(b, op.swing_low_anchor(), "from_swing")
    b = op.anchored_vwap(b, op.break_anchor(), "from_break")
    b = op.anchored_vwap(b, F.col("bucket") == F.lit(START + 5 * DAY), "from_time")
    return rounded(b.select("symbol", "bucket", "from_swing", "from_break", "from_time"), "from_swing", "from_break", "from_time")


def funding(s, d):
    samples = hourly(s, d).where(F.col("bucket") % (8 * HOUR) == 0).select("symbol", "bucket", (F.col("delta") / 100_000).alias("rate"))
    return rounded(op.funding_regime(samples), "rate", "share_below", "mean_rate", "velocity", digits=8)


def naked(s, d):
    days = bar_op.time_bars(trades(s, d), DAY).select("symbol", (F.col("bucket") / DAY).cast("long").alias("day"), "high", "low")
    poc = profile.top_volume_area(profile.day_profile(trades(s, d), STEP)).select("symbol", "day", (F.col("poc") / 1e8).alias("level"))
    return op.naked_levels(poc, days, 0.001)


def targets(s, d):
    b = hourly(s, d).withColumns({"a": F.max("high").over(op.rows(-20, -1)), "b": F.max("high").over(op.rows(-5, -1)), "c": F.lag("high").over(op.by_time())})
    near, far = op.structural_targets(F.col("close"), F.array_compact(F.array("a", "b", "c")))
    return b.select("symbol", "bucket", near.alias("near"), far.alias("far"))


def density(s, d):
    swings = hourly(s, d).where("volume >= 400").select("symbol", "bucket", "high", "volume")
    return rounded(op.liquidation_density(swings, START + 30 * DAY, 100 * HOUR).where("nth <= 10"), "weight")


def hysteresis(s, d):
    b = hourly(s, d).withColumn("x", F.coalesce(F.try_divide("delta", "volume"), F.lit(0.0)))
    return op.hysteresis(b, "x", 0.8, 0.2).select("symbol", "bucket", "state")


def horizons(s, d):
    b = numbered_bars(s, d)
    signals = b.select("symbol", "n", F.col("close").alias("entry"), (F.col("close") * 0.9).alias("stop"))
    out = op.outcome_horizons(signals, b, (1, 3, 12)).select("symbol", "n", F.col("1").alias("r1"), F.col("3").alias("r3"), F.col("12").alias("r12"))
    return rounded(out, "r1", "r3", "r12")


def sticky(s, d):
    return op.sticky_regime(structure.regime(numbered_bars(s, d)))


def ranges(s, d):
    return rounded(op.range_state(numbered_bars(s, d)).select("symbol", "bucket", "range_high", "range_low", "range_size", "place"), "range_size")


FOUR = 4 * HOUR
QUERIES = {
    "vwap_anchored": (
        anchored,
        f"""WITH {B}, x AS (SELECT *, (high + low + close) / 3 AS tp, lag(low) OVER {ORDER} AS l1, lag(low, 2) OVER {ORDER} AS l2, max(high) OVER {before(299)} AS hh, min(low) OVER {before(299)} AS ll FROM b),
g AS (SELECT *, sum(CAST(coalesce(l1 < l2 AND l1 < low, false) AS INT)) OVER {ALL} AS g1, sum(CAST(coalesce(close > hh OR close < ll, false) AS INT)) OVER {ALL} AS g2, sum(CAST(bucket = {START + 5 * DAY} AS INT)) OVER {ALL} AS g3 FROM x)
SELECT symbol, bucket, CASE WHEN g1 > 0 THEN round(sum(tp * volume) OVER w1 / nullif(sum(volume) OVER w1, 0), 6) END AS from_swing, CASE WHEN g2 > 0 THEN round(sum(tp * volume) OVER w2 / nullif(sum(volume) OVER w2, 0), 6) END AS from_break,
CASE WHEN g3 > 0 THEN round(sum(tp * volume) OVER w3 / nullif(sum(volume) OVER w3, 0), 6) END AS from_time FROM g
WINDOW w1 AS (PARTITION BY symbol, g1 ORDER BY bucket), w2 AS (PARTITION BY symbol, g2 ORDER BY bucket), w3 AS (PARTITION BY symbol, g3 ORDER BY bucket)""",
    ),
    "delta_velocity": (
        lambda s, d: rounded(numbered_bars(s, d).select("symbol", "bucket", op.delta_velocity().alias("velocity")), "velocity"),
        f"WITH {N} SELECT symbol, bucket, CASE WHEN count(*) OVER {back(5)} >= 5 THEN round(regr_slope(delta, n) OVER {back(5)} / nullif(avg(tr) OVER {back(14)}, 0), 6) END AS velocity FROM n",
    ),
    "micro_slots": (
        lambda s, d: op.micro_slots(trades(s, d), 5 * HOUR, HOUR),
        f"""WITH {T}, x AS (SELECT *, ts_ms - ts_ms % {5 * HOUR} AS candle, CAST(ts_ms % {5 * HOUR} // {HOUR} AS INTEGER) AS slot FROM t),
s AS (SELECT symbol, candle, slot, CAST(sum(CASE WHEN is_sell THEN 0 ELSE qty END) AS BIGINT) AS buy_qty, CAST(sum(CASE WHEN is_sell THEN qty ELSE 0 END) AS BIGINT) AS sell_qty, last(price ORDER BY ts_ms, seq) AS close FROM x GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT s.symbol, s.candle, CAST(r.range AS INTEGER) AS slot FROM s, range(5) r)
SELECT symbol, candle, slot, coalesce(buy_qty, 0) AS buy_qty, coalesce(sell_qty, 0) AS sell_qty, close FROM g LEFT JOIN s USING (symbol, candle, slot)""",
    ),
    "micro_window": (
        lambda s, d: op.micro_window(op.micro_slots(trades(s, d), 5 * HOUR, HOUR)),
        f"""WITH {T}, x AS (SELECT symbol, ts_ms - ts_ms % {5 * HOUR} AS candle, ts_ms % {5 * HOUR} // {HOUR} AS slot, CASE WHEN is_sell THEN -qty ELSE qty END AS q FROM t), k AS (SELECT DISTINCT symbol, candle FROM x),
p AS (SELECT k.symbol, k.candle, list(coalesce(z.d, 0) ORDER BY r.range) AS d FROM k CROSS JOIN range(5) r LEFT JOIN (SELECT symbol, candle, slot, sum(q) AS d FROM x GROUP BY 1, 2, 3) z ON z.symbol = k.symbol AND z.candle = k.candle AND z.slot = r.range GROUP BY 1, 2),
y AS (SELECT *, list_sum(d) AS delta, list_sum([abs(v) FOR v IN d]) AS gross, d[1] + d[2] AS first_half, [sign(v) FOR v IN d IF v <> 0] AS g FROM p)
SELECT symbol, candle, CAST(delta AS BIGINT) AS delta, CAST(gross AS BIGINT) AS gross, CAST(coalesce(list_sum([CASE WHEN g[i] <> g[i + 1] THEN 1 ELSE 0 END FOR i IN range(1, len(g))]), 0) AS INTEGER) AS flips, CAST(first_half AS BIGINT) AS first_half,
CASE WHEN gross = 0 THEN 'empty' WHEN abs(delta) * 2 >= gross THEN 'one_sided' WHEN first_half * (delta - first_half) < 0 THEN 'reversal' ELSE 'mixed' END AS shape FROM y""",
    ),
    "stacked_levels": (
        lambda s, d: op.stacked_levels(cells(s, d), 3),
        f"""WITH {FOOT}, c AS (SELECT symbol, bucket, level, CAST(sign(buy_qty - sell_qty) AS INTEGER) AS sign FROM f),
n AS (SELECT *, CAST(sign <> coalesce(lag(sign) OVER w, 9) AS INT) AS new FROM c WINDOW w AS (PARTITION BY symbol, bucket ORDER BY level)),
r AS (SELECT *, sum(new) OVER (PARTITION BY symbol, bucket ORDER BY level) AS run FROM n),
k AS (SELECT symbol, bucket, run, sign, min(level) AS low_level, count(*) AS levels FROM r WHERE sign <> 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)
SELECT DISTINCT ON (symbol, bucket) symbol, bucket, sign, low_level, levels FROM k ORDER BY symbol, bucket, low_level""",
    ),
    "big_levels": (
        lambda s, d: op.big_levels(cells(s, d)),
        f"""WITH {FOOT}, c AS (SELECT *, buy_qty + sell_qty > 2.5 * avg(buy_qty + sell_qty) OVER w AS big, level * 2 > min(level) OVER w + max(level) OVER w AS upper_ FROM f WINDOW w AS (PARTITION BY symbol, bucket))
SELECT symbol, bucket, bool_or(big AND NOT upper_) AS big_low, bool_or(big AND upper_) AS big_high FROM c GROUP BY 1, 2""",
    ),
    "range_states": (
        ranges,
        f"""WITH {N}, x AS (SELECT *, max(high) OVER {before(36)} AS rh, min(low) OVER {before(36)} AS rl, count(*) OVER {before(36)} AS k, avg(tr) OVER {before(14)} AS atr FROM n)
SELECT symbol, bucket, rh AS range_high, rl AS range_low, round((rh - rl) / atr, 6) AS range_size, CASE WHEN k < 36 THEN 'none' WHEN low < rl AND close > rl THEN 'sweep_low' WHEN high > rh AND close < rh THEN 'sweep_high'
WHEN close > rh THEN 'break_up' WHEN close < rl THEN 'break_down' WHEN close < rl + 0.25 * (rh - rl) THEN 'near_low' WHEN close > rh - 0.25 * (rh - rl) THEN 'near_high' ELSE 'middle' END AS place FROM x""",
    ),
    "funding_regimes": (
        funding,
        f"""WITH {B}, x AS (SELECT symbol, bucket, delta / 100000 AS rate FROM b WHERE bucket % {8 * HOUR} = 0),
y AS (SELECT *, list(rate) OVER {back(21)} AS seen, avg(rate) OVER {back(21)} AS mean_rate, rate - lag(rate, 2) OVER {ORDER} AS velocity FROM x),
z AS (SELECT *, len(list_filter(seen, lambda v: v < rate)) / len(seen) * 100 AS share_below FROM y)
SELECT symbol, bucket, round(rate, 8) AS rate, round(share_below, 8) AS share_below, round(mean_rate, 8) AS mean_rate, round(velocity, 8) AS velocity,
CASE WHEN share_below >= 90 THEN 'extreme_long' WHEN share_below <= 5 THEN 'extreme_short' WHEN mean_rate > 0.0004::DOUBLE THEN 'elevated' ELSE 'neutral' END AS regime FROM z""",
    ),
    "naked_levels": (
        naked,
        f"""WITH {PROFILE}, {bars_sql('e', DAY)}, l AS (SELECT symbol, day, first(level ORDER BY qty DESC, level) / 1e8::DOUBLE AS level FROM p GROUP BY 1, 2),
d AS (SELECT symbol, bucket // {DAY} AS day, high, low FROM e),
m AS (SELECT l.symbol, l.day, l.level, min(d.day) AS touched FROM l LEFT JOIN d ON d.symbol = l.symbol AND d.day > l.day AND d.low <= l.level * 1.001::DOUBLE AND d.high >= l.level * 0.999::DOUBLE GROUP BY 1, 2, 3)
SELECT *, coalesce(touched, (SELECT max(day) FROM d WHERE d.symbol = m.symbol)) - day AS days_naked FROM m""",
    ),
    "untouched_rounds": (
        lambda s, d: op.untouched_rounds(hourly(s, d), 10.0).select("symbol", "bucket", "round", "fresh"),
        f"""WITH {B}, x AS (SELECT *, round(close / 10) * 10 AS round, list({{'lo': low, 'hi': high}}) OVER {before(20)} AS seen FROM b)
SELECT symbol, bucket, round, coalesce(len(list_filter(seen, lambda v: v.lo <= round AND v.hi >= round)), 0) = 0 AS fresh FROM x""",
    ),
    "structural_targets": (
        targets,
        f"""WITH {B}, x AS (SELECT *, list_filter([max(high) OVER {before(20)}, max(high) OVER {before(5)}, lag(high) OVER {ORDER}], lambda v: v > close * 1.001::DOUBLE) AS l FROM b) SELECT symbol, bucket, list_min(l) AS near, list_max(l) AS far FROM x""",
    ),
    "liquidation_density": (
        density,
        f"""WITH {B}, x AS (SELECT symbol, bucket, high, volume, volume / sum(volume) OVER (PARTITION BY symbol) * exp(-ln(2) * ({START + 30 * DAY} - bucket) / {100 * HOUR}) AS weight FROM b WHERE volume >= 400),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, bucket) AS INTEGER) AS nth FROM x) SELECT symbol, bucket, high, volume, round(weight, 6) AS weight, nth FROM r WHERE nth <= 10""",
    ),
    "profile_from_candles": (
        lambda s, d: rounded(op.candle_profile(hourly(s, d), 5.0), "volume"),
        f"""WITH {B}, x AS (SELECT symbol, bucket // {DAY} AS day, CAST(floor(low / 5) AS BIGINT) AS a, CAST(floor(high / 5) AS BIGINT) AS z, volume FROM b), y AS (SELECT symbol, day, unnest(range(a, z + 1)) AS bin, volume / (z - a + 1) AS v FROM x)
SELECT symbol, day, bin, round(sum(v), 6) AS volume FROM y GROUP BY 1, 2, 3""",
    ),
    "rebased_closes": (
        lambda s, d: rounded(op.rebased(hourly(s, d), START + 10 * DAY), "change"),
        f"WITH {B} SELECT symbol, bucket, round(close / nullif(first_value(close) OVER {ORDER}, 0) - 1, 6) AS change FROM b WHERE bucket >= {START + 10 * DAY}",
    ),
    "regime_hysteresis": (
        hysteresis,
        f"""WITH RECURSIVE {B}, x AS (SELECT symbol, bucket, coalesce(delta / nullif(volume, 0), 0) AS x, row_number() OVER {ORDER} AS n FROM b),
r AS (SELECT symbol, bucket, n, x, CASE WHEN x >= 0.8::DOUBLE THEN 1 WHEN x <= -0.8::DOUBLE THEN -1 ELSE 0 END AS state FROM x WHERE n = 1 UNION ALL
SELECT x.symbol, x.bucket, x.n, x.x, CASE WHEN x.x >= 0.8::DOUBLE THEN 1 WHEN x.x <= -0.8::DOUBLE THEN -1 WHEN abs(x.x) <= 0.2::DOUBLE OR sign(x.x) <> r.state THEN 0 ELSE r.state END FROM r JOIN x ON x.symbol = r.symbol AND x.n = r.n + 1)
SELECT symbol, bucket, CAST(state AS INTEGER) AS state FROM r""",
    ),
    "regime_sticky": (
        sticky,
        f"""WITH RECURSIVE {N}, a AS (SELECT *, avg(tr) OVER {back(14)} AS atr FROM n), x AS (SELECT symbol, bucket, n, CASE WHEN n > 1 THEN regr_slope(close, n) OVER {back(20)} END / nullif(atr, 0) AS slow,
CASE WHEN n > 1 THEN regr_slope(close, n) OVER {back(5)} END / nullif(atr, 0) AS fast, (max(high) OVER {back(20)} - min(low) OVER {back(20)}) / nullif(atr, 0) AS spread FROM a),
g AS (SELECT *, CASE WHEN slow > 0.12 AND fast > -0.35 THEN 'trend_up' WHEN slow < -0.12 AND fast < 0.35 THEN 'trend_down' WHEN spread > 8 THEN 'expansion' ELSE 'chop' END AS raw FROM x),
r AS (SELECT symbol, bucket, n, raw AS sticky FROM g WHERE n = 1 UNION ALL SELECT g.symbol, g.bucket, g.n, CASE WHEN raw <> 'expansion' AND (sticky = 'trend_up' AND (slow > 0.05 OR fast > 0.15) OR sticky = 'trend_down' AND (slow < -0.05 OR fast < -0.15)) THEN sticky ELSE raw END
FROM r JOIN g ON g.symbol = r.symbol AND g.n = r.n + 1) SELECT symbol, bucket, sticky FROM r""",
    ),
    "outcome_horizons": (
        horizons,
        f"""WITH {N}, s AS (SELECT symbol, n, close AS entry, close * 0.9::DOUBLE AS stop FROM n)
SELECT s.symbol, CAST(s.n AS INTEGER) AS n, round((a.close - entry) / (entry - stop), 6) AS r1, round((b.close - entry) / (entry - stop), 6) AS r3, round((c.close - entry) / (entry - stop), 6) AS r12
FROM s LEFT JOIN n a ON a.symbol = s.symbol AND a.n = s.n + 1 LEFT JOIN n b ON b.symbol = s.symbol AND b.n = s.n + 3 LEFT JOIN n c ON c.symbol = s.symbol AND c.n = s.n + 12""",
    ),
    "large_trade_flow": (
        lambda s, d: op.large_trade_flow(trades(s, d)),
        f"""WITH RECURSIVE {T}, k AS (SELECT *, ts_ms - ts_ms % {HOUR} AS bucket, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq) AS n FROM t),
r AS (SELECT symbol, n, bucket, 0.02::DOUBLE * qty + 0.98::DOUBLE * 5 AS mean, 20::DOUBLE AS limit_ FROM k WHERE n = 1 UNION ALL
SELECT k.symbol, k.n, k.bucket, 0.02::DOUBLE * k.qty + 0.98::DOUBLE * r.mean, CASE WHEN k.bucket <> r.bucket THEN r.mean * 4 ELSE r.limit_ END FROM r JOIN k ON k.symbol = r.symbol AND k.n = r.n + 1)
SELECT symbol, k.bucket, CAST(sum(CASE WHEN qty > limit_ THEN CASE WHEN is_sell THEN -qty ELSE qty END ELSE 0 END) AS BIGINT) AS flow FROM k JOIN r USING (symbol, n) GROUP BY 1, 2""",
    ),
}
