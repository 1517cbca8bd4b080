"""Registered queries: scans, the imbalance maker and states of the auction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY
from ..operators import indicators, microevents, scalps, scan
from ..operators.indicators import rows
from ..sources import trades as src
from .base import N, T, numbered_bars, rounded
from .books import STATE, seconds

R = scalps.MakerRules(spread_ticks=20_000.0, least_volume=0.8, away=0.02, long_at=0.52, short_at=0.48, reward=1.2, london_score=56.0)
FAST, SLOW = 0.3, 0.1


def flow_memory(s, d):
    """Signed quantity that halves in six hours, and the mean size of trades, both over the whole history of a symbol."""
    t = src.trades(s, d).withColumn("signed", F.when(F.col("is_sell"), -F.col("qty")).otherwise(F.col("qty")).cast("double")).select("symbol", "ts_ms", "seq", "qty", "signed")
    # the row before may lie in another day: days are joined by their last row, so that no window spans a symbol
    by_day = Window.partitionBy("symbol", F.floor(F.col("ts_ms") / DAY)).orderBy("ts_ms", "seq")
    last = t.groupBy("symbol", F.floor(F.col("ts_ms") / DAY).alias("day")).agg(F.max("ts_ms").alias("last"))
    last = last.withColumn("before", F.lag("last").over(Window.partitionBy("symbol").orderBy("day"))).drop("last")
    t = t.withColumns({"day": F.floor(F.col("ts_ms") / DAY), "prev": F.lag("ts_ms").over(by_day)}).join(last, ["symbol", "day"])
    t = t.withColumn("since", (F.col("ts_ms") - F.coalesce("prev", "before")).cast("double")).drop("day", "prev", "before")
    out = scan.decayed_sum(t, "symbol", ["ts_ms", "seq"], "signed", F.col("since"), 6 * 3_600_000.0, "memory")
    out = scan.sample_ema(out, "symbol", ["ts_ms", "seq"], "qty", 0.05, "mean_qty")
    return rounded(out.select("symbol", "seq", "memory", "mean_qty"), "memory", "mean_qty")


def samples(s, d):
    p = microevents.second_panel(seconds(s, d), src.trades(s, d)).withColumn("share", (F.col("obi5") + 1) / 2)
    p = p.select("symbol", "ts_ms", "mid", "micro", "spread_bps", "share", "vol", "delta")
    p = scan.sample_ema(scan.sample_ema(p, "symbol", ["ts_ms"], "share", FAST, "fast"), "symbol", ["ts_ms"], "share", SLOW, "slow")
    day = Window.partitionBy("symbol", F.floor(F.col("ts_ms") / DAY)).orderBy("ts_ms")
    span = day.rowsBetween(-9, 0)
    return p.withColumns({"spread_ticks": F.round(F.col("spread_bps") * F.col("mid") / 1e4 / 0.10, 3), "vr": F.col("vol") / F.avg("vol").over(span), "cvd": F.sum("delta").over(day), "close": F.col("mid"), "atr": F.max("mid").over(span) - F.min("mid").over(span)})


def maker(s, d):
    out = scalps.imbalance_maker(samples(s, d), R)
    return rounded(out.select("symbol", "ts_ms", "side", "entry", "stop", "near", "far", "reward", "score"), "entry", "stop", "near", "far", "reward", "score")


def auction_states(s, d):
    b = numbered_bars(s, d)
    b = b.withColumns({"value_high": F.max("close").over(rows(-6, -1)), "value_low": F.min("close").over(rows(-6, -1)), "slope": F.try_divide(F.sum("delta").over(rows(-3)), F.sum("volume").over(rows(-3))), "taker": F.try_divide("delta", "volume")})
    rise, flow = F.col("close") - F.lag("close", 3).over(indicators.by_time()), F.sum("delta").over(rows(-2))
    b = b.withColumns({"oi_aligned": F.col("n_trades") >= 4, "divergence": F.when((rise > 0) & (flow < 0), 3).when((rise < 0) & (flow > 0), -3).otherwise(0), "vpin_share": F.when(F.col("n") > 10, F.abs("taker"))})
    out = scalps.auction_state(b)
    return out.select("symbol", "bucket", "state", "confidence", F.concat_ws(",", "reasons").alias("reasons"))


#: Hours of the event table on a level where a tenth of a coin is a tick.
LEVEL = 60_000
A = scalps.FadeRules(delta_z=0.4, least_volume=0.6, score=12.0, reward=0.2, spread_ticks=4.0, lookback=12, strength=0.05, history=30, most_volume=3.0)


def fade_bars(s, d):
    b = numbered_bars(s, d).withColumns({c: F.col(c) + LEVEL for c in ("open", "high", "low", "close")})
    b = indicators.cvd(b)
    z = F.try_divide(F.col("delta") - F.avg("delta").over(rows(-19)), F.stddev_pop("delta").over(rows(-19)))
    return b.withColumns(
        {
            "dz": F.coalesce(z, F.lit(0.0)), "vr": F.try_divide("volume", F.avg("volume").over(rows(-19))), "atr": F.avg("tr").over(rows(-13)), "spread_ticks": (F.col("n_trades") % 6).cast("double"), "regime": F.lit("range"),
            "range_high": F.max("close").over(rows(-12, -1)), "range_low": F.min("close").over(rows(-12, -1)), "candle_poc": (F.col("open") + F.col("low")) / 2, "poc": F.when(F.col("n") % 2 == 0, F.avg("close").over(rows(-30, -1))),
            "big_sell": F.col("sell_qty") > 150, "big_buy": F.col("buy_qty") > 150, "liq_ratio": F.col("sell_qty") / 40, "obi_fast": 0.5 + F.coalesce(F.try_divide("delta", "volume"), F.lit(0.0)) / 10,
        }
    )


FADE = ("entry", "stop", "near", "far", "reward", "score")


def absorption(s, d):
    return rounded(scalps.absorption_fade(fade_bars(s, d), A).select("symbol", "bucket", "side", *FADE, "hurry"), *FADE)


def divergence(s, d):
    return rounded(scalps.divergence_fade(fade_bars(s, d), A).select("symbol", "bucket", "side", *FADE, "strength", "bars_ago"), *FADE, "strength")


FADE_BARS = f"""{N}, fb0 AS (SELECT symbol, bucket, n, n_trades, delta, volume, tr, buy_qty, sell_qty, open + {LEVEL} AS o, high + {LEVEL} AS h, low + {LEVEL} AS l, close + {LEVEL} AS c, sum(delta) OVER (PARTITION BY symbol, bucket // {DAY} ORDER BY n) AS cvd FROM n),
fb AS (SELECT *, coalesce((delta - avg(delta) OVER (w ROWS 19 PRECEDING)) / nullif(stddev_pop(delta) OVER (w ROWS 19 PRECEDING), 0), 0) AS dz, volume / nullif(avg(volume) OVER (w ROWS 19 PRECEDING), 0) AS vr, greatest(avg(tr) OVER (w ROWS 13 PRECEDING), 10) AS atr,
  avg(tr) OVER (w ROWS 13 PRECEDING) AS atr0, max(c) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rh, min(c) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rl, CASE WHEN n % 2 = 0 THEN avg(c) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS poc,
  list(cvd) OVER (w ROWS {A.flow_bars - 1} PRECEDING) AS flows, list({{h: h, l: l, v: cvd}}) OVER (w ROWS {A.lookback - 1} PRECEDING) AS win, list({{h: h, l: l}}) OVER (w ROWS BETWEEN {A.history - 1} PRECEDING AND 1 PRECEDING) AS past, bucket // 60000 % 1440 < 1260 AS open_
  FROM fb0 WINDOW w AS (PARTITION BY symbol ORDER BY n))"""
RAMP = lambda x, a, b: f"least(greatest((({x}) - {a}) / ({b} - {a}) :: DOUBLE, 0), 1)"
ABSORPTION_SQL = f"""WITH {FADE_BARS}, a AS (SELECT *, CASE WHEN coalesce((c - rl) / nullif(rh - rl, 0), 0.5) < 0.35 THEN 1 WHEN coalesce((c - rl) / nullif(rh - rl, 0), 0.5) > 0.65 THEN -1 END AS s FROM fb WHERE open_ AND rh IS NOT NULL AND n_trades % 6 <= {A.spread_ticks} AND vr BETWEEN {A.least_volume} AND {A.most_volume}),
b_ AS (SELECT *, CASE WHEN len(flows) >= 4 THEN len(list_filter(range(2, len(flows) + 1), lambda i: s * (flows[i] - flows[i - 1]) > 0)) ELSE 0 END AS turns, CASE WHEN s > 0 THEN (o + l) / 2 - l ELSE h - (o + l) / 2 END / greatest(h - l, 1e-9 :: DOUBLE) AS wick, abs(c - CASE WHEN s > 0 THEN rl ELSE rh END) / atr0 AS dist
  FROM a WHERE s * dz <= -{A.delta_z} AND CASE WHEN s > 0 THEN c >= rl ELSE c <= rh END AND s * (c - o) > 0),
e AS (SELECT *, 22 * {RAMP("greatest(-s * dz, 0)", 1.5, 3)} + 12 * {RAMP("abs(dz)", 1.5, 2.5)} + 10 * {RAMP("vr", 2, 4)} + 12 * greatest(0.35 :: DOUBLE - wick, 0) / 0.35 :: DOUBLE + 18 * greatest(0.25 :: DOUBLE - dist, 0) / 0.25 :: DOUBLE + 8 * {RAMP("turns", 1, 3)}
  + CASE WHEN CASE WHEN s > 0 THEN sell_qty > 150 ELSE buy_qty > 150 END THEN 6 ELSE 0 END + 6 * {RAMP("sell_qty / 40", 3, 8)} AS score, c + s * 0.1 :: DOUBLE AS entry, CASE WHEN s > 0 THEN least(l - 0.25 * atr, rl - 3 * 0.1 :: DOUBLE) ELSE greatest(h + 0.25 * atr, rh + 3 * 0.1 :: DOUBLE) END AS stop, coalesce(poc, rl + (rh - rl) * 0.5) AS near FROM b_)
SELECT symbol, bucket, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(near, 6) AS near, round(CASE WHEN s > 0 THEN rh ELSE rl END, 6) AS far, round(abs(near - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE), 6) AS reward, round(score, 6) AS score, abs(dz) > 2.5 AND vr > 3 AS hurry
FROM e WHERE score >= {A.score} AND abs(near - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE) >= {A.reward}"""


def swings_sql(price: str, s: int) -> str:
    """Places (from 1) of a window's swings of one side."""
    at = lambda i: f"{s} * win[{i}].{price}"
    return f"list_filter(range(3, {A.lookback}), lambda i: {at('i')} >= {at('i - 1')} AND {at('i')} >= {at('i - 2')} AND {at('i')} >= {at('i + 1')})"


DIVERGENCE_SQL = f"""WITH {FADE_BARS}, w AS (SELECT *, {swings_sql("h", 1)} AS tops, {swings_sql("l", -1)} AS lows, list_avg(list_transform(win, lambda x: abs(x.v))) AS mean FROM fb WHERE len(win) = {A.lookback}),
p AS (SELECT *, win[tops[-1]] AS t1, win[tops[-2]] AS t0, win[lows[-1]] AS b1, win[lows[-2]] AS b0 FROM w WHERE mean >= 1e-9),
g AS (SELECT *, CASE WHEN len(tops) >= 2 AND t1.h >= t0.h AND t0.v > t1.v AND (t0.v - t1.v) / mean >= {A.strength} THEN (t0.v - t1.v) / mean END AS up, CASE WHEN len(lows) >= 2 AND b1.l <= b0.l AND b1.v > b0.v AND (b1.v - b0.v) / mean >= {A.strength} THEN (b1.v - b0.v) / mean END AS dn FROM p),
k AS (SELECT *, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up >= dn) THEN -1 ELSE 1 END AS s, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up >= dn) THEN {A.lookback} - tops[-1] ELSE {A.lookback} - lows[-1] END AS ago FROM g WHERE up IS NOT NULL OR dn IS NOT NULL),
f AS (SELECT *, CASE WHEN s < 0 THEN up ELSE dn END AS strength, CASE WHEN s < 0 THEN t1.h ELSE b1.l END AS level, coalesce(poc, c + s * atr * 1.5) AS other, coalesce(CASE WHEN s > 0 THEN list_filter(past, lambda x: x.h > c)[-1].h ELSE list_filter(past, lambda x: x.l < c)[-1].l END, c + s * atr * 0.8 :: DOUBLE) AS swing
  FROM k WHERE ago <= {A.fresh} AND open_ AND n_trades % 6 <= {A.spread_ticks} AND vr <= {A.most_volume} AND s * (0.5 :: DOUBLE + coalesce(delta / nullif(volume, 0), 0) / 10 - 0.5 :: DOUBLE) > -0.02 AND s * dz > -0.5),
z AS (SELECT *, c + s * 0.1 :: DOUBLE AS entry, level - s * atr * 0.3 :: DOUBLE AS stop, CASE WHEN s > 0 THEN greatest(swing, other) ELSE least(swing, other) END AS aim FROM f)
SELECT symbol, bucket, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(aim, 6) AS near, round(aim, 6) AS far, round(abs(aim - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE), 6) AS reward,
  round(least(greatest(strength * 30, 55), 95), 6) AS score, round(strength, 6) AS strength, CAST(ago AS INTEGER) AS bars_ago FROM z WHERE abs(aim - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE) >= {A.reward}"""

MEMORY_SQL = f"""WITH RECURSIVE {T}, o AS (SELECT symbol, seq, ts_ms, qty, CASE WHEN is_sell THEN -qty ELSE qty END AS signed, row_number() OVER w AS k, ts_ms - lag(ts_ms) OVER w AS since FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, seq)),
r AS (SELECT symbol, k, seq, signed :: DOUBLE AS memory, qty :: DOUBLE AS mean_qty FROM o WHERE k = 1
  UNION ALL SELECT o.symbol, o.k, o.seq, r.memory * pow(0.5 :: DOUBLE, o.since / 21600000) + o.signed, r.mean_qty * 0.95 :: DOUBLE + o.qty * 0.05 :: DOUBLE FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1)
SELECT symbol, seq, round(memory, 6) AS memory, round(mean_qty, 6) AS mean_qty FROM r"""

MAKER_SQL = f"""WITH RECURSIVE {STATE}, tq AS (SELECT symbol, ts_ms, seq, max(q) FILTER (side = 'b' AND k = 1) AS bq, max(q) FILTER (side = 'a' AND k = 1) AS aq FROM rk GROUP BY ALL),
sec AS (SELECT smp.symbol, smp.day, smp.ts_ms, mid, spread, (o5 + 1) / 2 AS share, (bid * aq + ask * bq) / (bq + aq) AS micro FROM smp JOIN tq USING (symbol, ts_ms, seq) QUALIFY row_number() OVER (PARTITION BY symbol, smp.ts_ms // 1000 ORDER BY smp.ts_ms DESC, seq DESC) = 1),
fl AS (SELECT symbol, ts_ms // 1000 AS second, CAST(sum(qty) AS BIGINT) AS vol, CAST(sum(CASE WHEN is_sell THEN -qty ELSE qty END) AS BIGINT) AS delta FROM t GROUP BY 1, 2),
p AS (SELECT sec.*, coalesce(vol, 0) AS vol, coalesce(delta, 0) AS delta, row_number() OVER (PARTITION BY sec.symbol ORDER BY ts_ms) AS k FROM sec LEFT JOIN fl ON fl.symbol = sec.symbol AND fl.second = sec.ts_ms // 1000),
e AS (SELECT symbol, k, share :: DOUBLE AS fast, share :: DOUBLE AS slow FROM p WHERE k = 1
  UNION ALL SELECT p.symbol, p.k, e.fast * (1 - {FAST} :: DOUBLE) + p.share * {FAST} :: DOUBLE, e.slow * (1 - {SLOW} :: DOUBLE) + p.share * {SLOW} :: DOUBLE FROM e JOIN p ON p.symbol = e.symbol AND p.k = e.k + 1),
m AS (SELECT p.*, fast, slow, round(spread * mid / 10000 / 0.1 :: DOUBLE, 3) AS ticks, vol / avg(vol) OVER (w ROWS 9 PRECEDING) AS vr, sum(delta) OVER w AS cvd, max(mid) OVER (w ROWS 9 PRECEDING) - min(mid) OVER (w ROWS 9 PRECEDING) AS atr, ts_ms // 60000 % 1440 AS minute
  FROM p JOIN e USING (symbol, k) WINDOW w AS (PARTITION BY symbol, day ORDER BY ts_ms)),
s AS (SELECT *, CASE WHEN fast >= {R.long_at} AND cvd > 0 THEN 1 WHEN fast <= {R.short_at} AND cvd < 0 THEN -1 END AS s FROM m WHERE minute >= 480 AND minute < 1260 AND ticks <= {R.spread_ticks} AND vr BETWEEN {R.least_volume} AND {R.most_volume} AND abs(fast - 0.5) >= {R.away} AND abs(slow - 0.5) >= {R.away}),
q AS (SELECT *, round((micro - s * 2 * greatest(greatest(atr, 10) / 100, 1) * 0.1 :: DOUBLE + 4 * (fast - 0.5) * 0.1 :: DOUBLE) / 0.1 :: DOUBLE) * 0.1 :: DOUBLE AS entry FROM s WHERE s * (micro - mid) > 0),
g AS (SELECT *, greatest(entry * {R.cost} :: DOUBLE * 1.8 :: DOUBLE, 6 * 0.1 :: DOUBLE) AS aim, least(greatest(abs(fast - 0.5) * 200, 55), 95) AS score FROM q),
f AS (SELECT *, round((entry - s * aim * 0.65 :: DOUBLE) / 0.1 :: DOUBLE) * 0.1 :: DOUBLE AS stop, round((entry + s * aim) / 0.1 :: DOUBLE) * 0.1 :: DOUBLE AS near, round((entry + s * aim * 1.5 :: DOUBLE) / 0.1 :: DOUBLE) * 0.1 :: DOUBLE AS far FROM g)
SELECT symbol, ts_ms, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(near, 6) AS near, round(far, 6) AS far, round(abs(near - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE), 6) AS reward, round(score, 6) AS score
FROM f WHERE abs(near - entry) / greatest(abs(entry - stop), 0.1 :: DOUBLE) >= {R.reward} AND (minute >= 780 OR score >= {R.london_score})"""

#: The votes written out by hand, in the order of the reasons.
STATE_SQL = f"""WITH {N}, x AS (SELECT *, max(close) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS vh, min(close) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS vl, sum(delta) OVER (w ROWS 3 PRECEDING) / nullif(sum(volume) OVER (w ROWS 3 PRECEDING), 0) AS sl, delta / nullif(volume, 0) AS tk,
  close - lag(close, 3) OVER w AS rise, sum(delta) OVER (w ROWS 2 PRECEDING) AS fl FROM n WINDOW w AS (PARTITION BY symbol ORDER BY n)),
y AS (SELECT *, coalesce(close > vh, false) AS av, coalesce(close < vl, false) AS bv, coalesce(close <= vh AND close >= vl, false) AS iv, coalesce(sl > 0.05, false) AS cu, coalesce(sl < -0.05, false) AS cd, coalesce(tk > 0.1, false) AS tu, coalesce(tk < -0.1, false) AS td, n_trades >= 4 AS oi,
  coalesce(rise > 0 AND fl < 0, false) AS bear, coalesce(rise < 0 AND fl > 0, false) AS bull, n <= 10 OR coalesce(abs(tk) < 0.7, true) AS calm FROM x),
v AS (SELECT *, 30 * av::INT + 20 * cu::INT + 15 * (delta > 0)::INT + 15 * tu::INT + 20 * oi::INT AS u, 30 * bv::INT + 20 * cd::INT + 15 * (delta < 0)::INT + 15 * td::INT + 20 * oi::INT AS d, 10 * (av OR iv)::INT + 50 * bear::INT + 20 * cd::INT + 20 * (delta < 0)::INT AS ds,
  10 * (bv OR iv)::INT + 50 * bull::INT + 20 * cu::INT + 20 * (delta > 0)::INT AS ac, 30 * iv::INT + 20 * calm::INT + 25 * (NOT cu AND NOT cd)::INT + 25 * (delta = 0)::INT AS ba FROM y),
z AS (SELECT *, greatest(u, d, ds, ac, ba) AS best FROM v), k AS (SELECT *, CASE WHEN best < 30 THEN 'unknown' WHEN ba = best THEN 'balance' WHEN ac = best THEN 'accumulation' WHEN ds = best THEN 'distribution' WHEN d = best THEN 'down_imbalance' ELSE 'up_imbalance' END AS state FROM z)
SELECT symbol, bucket, state, CAST(CASE WHEN best < 30 THEN 0 ELSE least(best, 100) END AS INTEGER) AS confidence, CASE state
  WHEN 'up_imbalance' THEN concat_ws(',', CASE WHEN av THEN 'above_value' END, CASE WHEN cu THEN 'cvd_up' END, CASE WHEN delta > 0 THEN 'delta_up' END, CASE WHEN tu THEN 'taker_up' END, CASE WHEN oi THEN 'oi_expands' END)
  WHEN 'down_imbalance' THEN concat_ws(',', CASE WHEN bv THEN 'below_value' END, CASE WHEN cd THEN 'cvd_down' END, CASE WHEN delta < 0 THEN 'delta_down' END, CASE WHEN td THEN 'taker_down' END, CASE WHEN oi THEN 'oi_expands' END)
  WHEN 'distribution' THEN concat_ws(',', CASE WHEN av OR iv THEN 'near_top' END, CASE WHEN bear THEN 'bearish_divergence' END, CASE WHEN cd THEN 'cvd_down' END, CASE WHEN delta < 0 THEN 'delta_down' END)
  WHEN 'accumulation' THEN concat_ws(',', CASE WHEN bv OR iv THEN 'near_bottom' END, CASE WHEN bull THEN 'bullish_divergence' END, CASE WHEN cu THEN 'cvd_up' END, CASE WHEN delta > 0 THEN 'delta_up' END)
  WHEN 'balance' THEN concat_ws(',', CASE WHEN iv THEN 'in_value' END, CASE WHEN calm THEN 'calm' END, CASE WHEN NOT cu AND NOT cd THEN 'cvd_flat' END, CASE WHEN delta = 0 THEN 'delta_flat' END) ELSE '' END AS reasons FROM k"""

QUERIES = {"flow_memory": (flow_memory, MEMORY_SQL), "imbalance_maker": (maker, MAKER_SQL), "absorption_fade": (absorption, ABSORPTION_SQL), "divergence_fade": (divergence, DIVERGENCE_SQL), "auction_states": (auction_states, STATE_SQL)}
