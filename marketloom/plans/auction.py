"""Registered queries: scores, auctions around value, setups, liquidity and runs of a book, and more bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions.clocks import DAY, HOUR
from ..operators import auction, depth, reports, setups
from ..operators import bars as bar_op
from ..sources.trades import trades
from .bars import FOOT, cells
from .base import WIDE, B, N, T, bars_sql, hourly, numbered_bars, outcomes, rounded
from .indicators import ORDER


def last(n: int, to: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {n} PRECEDING AND {to})"


#: Adapter from bars to the inputs of the rules, in text that both dialects read.
STATE = {
    "atr": f"avg(tr) OVER {last(13)}", "vwap": f"sum(close * volume) OVER {last(23)} / nullif(sum(volume) OVER {last(23)}, 0)", "poc": f"CASE WHEN n % 2 = 0 THEN avg(close) OVER {last(9, '1 PRECEDING')} END",
    "value_high": f"max(close) OVER {last(6, '1 PRECEDING')}", "value_low": f"min(close) OVER {last(6, '1 PRECEDING')}", "taker": "CAST(delta AS DOUBLE) / nullif(volume, 0)",
    "prev_obi": f"lag(CAST(delta AS DOUBLE) / nullif(volume, 0)) OVER {ORDER}", "cvd_slope": f"CAST(sum(delta) OVER {last(4)} AS DOUBLE) / nullif(sum(volume) OVER {last(4)}, 0)",
    "fast": f"CAST(sum(delta) OVER {last(1)} AS DOUBLE) / nullif(sum(volume) OVER {last(1)}, 0)", "swing_high": f"max(high) OVER {last(20, '1 PRECEDING')}", "swing_low": f"min(low) OVER {last(20, '1 PRECEDING')}",
    "high5": f"max(high) OVER {last(5)}", "low5": f"min(low) OVER {last(5)}", "cvd": f"CAST(sum(delta) OVER {last(200)} AS DOUBLE)", "vr": f"volume / nullif(avg(volume) OVER {last(20, '1 PRECEDING')}, 0)",
}
MARKET = {
    "obi": "taker", "slope": "cvd_slope", "funding": "(n % 9 - 4) / 4e3", "basis": "CAST(delta AS DOUBLE) / 300", "spread": "CAST(volume % 5 AS DOUBLE)",
    "thin_above": "n % 3 <> 0", "thin_below": "n % 3 <> 1", "wall_above": "n % 11 = 0", "wall_below": "n % 13 = 0", "lvn": "close + atr * (n % 5 - 2) / 2", "micro": "close + taker * atr / 100",
    "block_high": "close + atr * (n % 4 - 1)", "block_low": "close + atr * (n % 4 - 3)", "absorbed": "n % 2 = 0", "regime": "CASE WHEN n % 7 = 0 THEN 'trend_up' WHEN n % 7 = 1 THEN 'trend_down' WHEN n % 7 = 2 THEN 'stress' ELSE 'chop' END",
    "liq_shorts": "CAST(buy_qty AS DOUBLE) / 60", "liq_longs": "CAST(sell_qty AS DOUBLE) / 60", "oi_slope": "CAST(n % 5 - 2 AS DOUBLE)", "top": "(2 + n % 7) / 1e1", "retail": "(2 + n % 6) / 1e1",
}
FOOT_H = FOOT.replace(f"ts_ms % {DAY}", f"ts_ms % {HOUR}")
select = lambda named: ", ".join(f"{v} AS {k}" for k, v in named.items())
S = f"""{N}, s0 AS (SELECT *, {select(STATE)} FROM n)"""
M = f"""{S}, m0 AS (SELECT *, {select(MARKET)}, [high5, close + atr, close - atr, low5] AS nodes, [close - atr, close + atr, close + 3 * atr, close - 3 * atr] AS walls,
[{{'price': close + (i - 5) * atr / 10, 'delta': ((n + i * i) % 5 - 3)::DOUBLE}} FOR i IN range(11)] AS levels FROM s0),
m AS (SELECT symbol, bucket, s, s * close AS px, atr, s * vwap AS vwap, s * poc AS poc, CASE s WHEN 1 THEN value_high ELSE -value_low END AS vh, CASE s WHEN 1 THEN value_low ELSE -value_high END AS vl,
s * obi AS obi, s * prev_obi AS prev_obi, s * taker AS taker, s * slope AS slope, s * fast AS fast, s * delta AS delta, s * funding AS funding, s * basis AS basis, spread, s * lvn AS lvn, s * micro AS micro,
CASE s WHEN 1 THEN swing_high ELSE -swing_low END AS sh, CASE s WHEN 1 THEN block_high ELSE -block_low END AS bh, CASE s WHEN 1 THEN block_low ELSE -block_high END AS bl, absorbed, regime, oi_slope,
CASE s WHEN 1 THEN thin_above ELSE thin_below END AS thin, CASE s WHEN 1 THEN wall_above ELSE wall_below END AS wall, CASE s WHEN 1 THEN liq_shorts ELSE liq_longs END AS lq, CASE s WHEN 1 THEN liq_longs ELSE liq_shorts END AS own,
CASE s WHEN 1 THEN top ELSE 1 - top END AS top, CASE s WHEN 1 THEN retail ELSE 1 - retail END AS retail, [s * x FOR x IN nodes] AS nodes, [s * x FOR x IN walls] AS walls, [{{'price': s * x.price, 'delta': s * x.delta}} FOR x IN levels] AS levels,
CASE s WHEN 1 THEN 'trend_down' ELSE 'trend_up' END AS against, coalesce(CASE s WHEN 1 THEN funding < 0.0008::DOUBLE ELSE funding > -0.0005::DOUBLE END, true) AS funding_ok FROM m0, (VALUES (1), (-1)) v(s))"""


def state(s, d):
    return numbered_bars(s, d).selectExpr("*", *[f"{v} AS {k}" for k, v in STATE.items()])


def market(s, d):
    m = state(s, d).selectExpr("*", *[f"{v} AS {k}" for k, v in MARKET.items()])
    level = lambda i: F.struct((F.col("close") + (i - 5) * F.col("atr") / 10).alias("price"), ((F.col("n") + i * i) % 5 - 3).cast("double").alias("delta"))
    return m.withColumns(
        {
            "nodes": F.expr("array(high5, close + atr, close - atr, low5)"), "walls": F.expr("array(close - atr, close + atr, close + 3 * atr, close - 3 * atr)"),
            "levels": F.transform(F.sequence(F.lit(0), F.lit(10)), level),
        }
    )


def setup_sql(name: str, when: str, stop: str, target: str, reward: float | None = 1.0) -> str:
    test = f" AND (target - px) / (px - stop) >= {reward}" if reward is not None else ""
    return f"SELECT symbol, bucket, s, '{name}' AS detector, px, {stop} AS stop, {target} AS target FROM m WHERE {when} AND stop < px AND target > px{test}"


NEAR = "abs(lvn - px) <= atr"
SETUPS_SQL = {
    "vacuum_breakout": setup_sql(
        "vacuum_breakout",
        f"thin AND {NEAR} AND px >= vwap AND px >= vl AND delta > 0 AND slope > 0 AND abs(taker) < 0.9::DOUBLE AND micro >= px AND spread <= 3 AND NOT wall AND basis <= 0.5::DOUBLE AND funding_ok",
        "greatest(least(vwap, px - 0.75::DOUBLE * atr), px - 2 * atr)", "list_min(list_filter(list_concat(nodes, [vh, sh]), lambda x: x > px))",
    ),
    "book_breakout": setup_sql(
        "book_breakout", f"obi > 0.2::DOUBLE AND prev_obi > 0.1::DOUBLE AND thin AND {NEAR} AND px > vwap AND slope > 0 AND fast > -0.5::DOUBLE AND spread <= 3 AND basis <= 0.5::DOUBLE",
        "list_max(list_filter(walls, lambda x: x < px))", "list_min(list_filter(nodes, lambda x: x > px))",
    ),
    "block_retest": setup_sql("block_retest", "px >= bl AND px <= bh AND absorbed AND slope >= 0 AND obi > 0 AND regime NOT IN ('stress', 'aftermath', against) AND spread <= 3", "bl - 0.5::DOUBLE * atr", "sh"),
    "footprint_absorption": setup_sql(
        "footprint_absorption",
        """px > vl AND px <= vl + 0.3::DOUBLE * atr AND obi > 0 AND slope > -0.05::DOUBLE AND taker > -0.1::DOUBLE AND regime <> against AND regime <> 'stress' AND spread <= 3
AND contains(array_to_string([CASE WHEN x.delta < 0 THEN '1' ELSE '0' END FOR x IN list_sort(list_filter(levels, lambda y: y.price >= vl - 0.5::DOUBLE * atr AND y.price <= vl + 0.3::DOUBLE * atr))], ''), '111')""",
        "vl - atr", "CASE WHEN poc > px THEN poc ELSE vh END",
    ),
    "liquidation_hunt": setup_sql(
        "liquidation_hunt", "lq > own AND lq > 1.5::DOUBLE AND oi_slope > 0 AND taker > 0.15::DOUBLE AND slope > 0 AND thin AND NOT (funding > 0.0008::DOUBLE AND retail - top > 0.15::DOUBLE) AND own < 3",
        "px - atr", "list_min(list_filter(list_concat(nodes, [vh]), lambda x: x >= px + atr))",
    ),
    "funding_exhaustion": setup_sql(
        "funding_exhaustion", "funding < -0.0008::DOUBLE AND top > 0.48::DOUBLE AND retail < 0.38::DOUBLE AND oi_slope < 0 AND slope >= 0 AND taker > 0 AND lq < 3",
        "least(coalesce(vl, px - 0.75::DOUBLE * atr), px - 0.75::DOUBLE * atr)", "CASE WHEN vh > px THEN vh ELSE px + 2 * atr END", None,
    ),
    "crowd_fade": setup_sql(
        "crowd_fade", "top - retail > 0.2::DOUBLE AND funding <= 0 AND oi_slope < 1 AND px <= vl + 0.5::DOUBLE * atr AND slope >= 0 AND greatest(lq, own) < 3",
        "px - 1.5::DOUBLE * atr", "CASE WHEN vh > px THEN vh ELSE px + 3 * atr END", None,
    ),
}


def setup_query(name):
    run = lambda s, d: rounded(setups.found(market(s, d), [name]), "entry", "stop", "target")
    sql = f"""WITH {M}, f AS ({SETUPS_SQL[name]})
SELECT symbol, bucket, CASE s WHEN 1 THEN 'long' ELSE 'short' END AS side, detector, round(s * px, 6) AS entry, round(s * stop, 6) AS stop, round(s * target, 6) AS target FROM f"""
    return run, sql


def score_rules(s, d):
    b = market(s, d)
    long = F.col("delta") > 0
    c = F.col
    turns = scores.reversals(F.collect_list("close").over(auction.rows(-4)))
    return b.select(
        "symbol", "bucket", scores.wall_nearby(c("walls"), c("high"), c("atr")).alias("wall_near"), scores.wall_bonus(c("thin_above"), c("thin_below"), long).alias("wall_bonus"), turns.alias("turns"),
        scores.clean_bonus(turns).alias("clean_bonus"), scores.funding_penalty(c("funding"), long).alias("penalty"), scores.aligned_bonus(F.when(c("n") % 3 > 0, c("n") % 3 == 1)).alias("oi_bonus"),
        scores.toxic_reason(c("regime"), c("n") % 17 != 0, c("n") % 19 != 0, F.when(c("n") % 23 > 0, F.lit(True)), c("spread"), 3.0, c("taker"), 0.7, c("wall_above")).alias("reason"),
        scores.zone(c("close"), c("swing_low"), c("swing_high")).alias("zone"), scores.effective_regime(c("regime"), c("fast")).alias("effective"), F.round(scores.basis_pct(c("close"), c("vwap")), 6).alias("basis_pct"),
        scores.first_sided(F.when(c("n") % 2 == 0, "none").otherwise("bullish"), c("regime")).alias("sided"), scores.open_interest_multiplier(c("volume"), F.lag("volume").over(auction.by_time())).alias("size_mult"),
        scores.crowd_divergence(F.when(c("n") % 4 > 0, c("top")), c("retail")).alias("crowd"),
    )


SCORE_SQL = f"""WITH {S}, m0 AS (SELECT *, {select(MARKET)}, list(close) OVER {last(4)} AS cl FROM s0), x AS (SELECT *, delta > 0 AS long,
CAST(coalesce(list_sum([CASE WHEN (cl[i + 1] - cl[i]) * (cl[i + 2] - cl[i + 1]) < 0 THEN 1 ELSE 0 END FOR i IN range(1, len(cl) - 1)]), 0) AS INTEGER) AS turns, CASE WHEN n % 4 > 0 THEN top ELSE 0.5 END AS t, (volume / nullif(lag(volume) OVER {ORDER}, 0) - 1) * 100 AS oi FROM m0)
SELECT symbol, bucket, atr > 0 AND len(list_filter([close - atr, close + atr, close + 3 * atr, close - 3 * atr], lambda w: abs(w - high) <= atr)) > 0 AS wall_near, CASE WHEN CASE WHEN long THEN thin_above ELSE thin_below END THEN 0.08::DOUBLE ELSE 0 END AS wall_bonus, turns,
CASE WHEN turns <= 2 THEN 0.05::DOUBLE ELSE 0 END AS clean_bonus, CASE WHEN CASE WHEN long THEN funding ELSE -funding END > 0.0006::DOUBLE THEN -0.2::DOUBLE WHEN CASE WHEN long THEN funding ELSE -funding END > 0.0003::DOUBLE THEN -0.1::DOUBLE ELSE 0 END AS penalty,
CASE WHEN n % 3 = 1 THEN 0.1::DOUBLE ELSE 0 END AS oi_bonus, CASE WHEN regime IN ('stress', 'aftermath') THEN 'blocked_regime' WHEN n % 17 = 0 THEN 'flow_not_live' WHEN n % 19 = 0 THEN 'profile_not_live' WHEN n % 23 = 0 THEN 'book_not_live' WHEN spread > 3 THEN 'spread_too_wide' WHEN taker > 0.7::DOUBLE THEN 'toxic_flow' WHEN wall_above THEN 'spoofed' END AS reason,
CASE WHEN swing_high > swing_low THEN CASE WHEN close > swing_low + 0.75::DOUBLE * (swing_high - swing_low) THEN 'premium' WHEN close < swing_low + 0.25::DOUBLE * (swing_high - swing_low) THEN 'discount' ELSE 'equilibrium' END ELSE 'unknown' END AS zone,
CASE WHEN regime = 'trend_up' AND fast < -0.35::DOUBLE THEN 'trend_down' WHEN regime = 'trend_down' AND fast > 0.35::DOUBLE THEN 'trend_up' ELSE regime END AS effective, round((close / vwap - 1) * 100, 6) AS basis_pct,
CASE WHEN n % 2 = 0 THEN regime ELSE 'bullish' END AS sided, CASE WHEN oi > 0.1::DOUBLE THEN 2::DOUBLE WHEN oi < -0.1::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS size_mult,
CASE WHEN retail - t > 0.15::DOUBLE THEN 'smart_short_retail_long' WHEN retail - t < -0.15::DOUBLE THEN 'smart_long_retail_short' WHEN abs(t - 0.5) < 0.1::DOUBLE AND abs(retail - 0.5) < 0.1::DOUBLE THEN 'neutral' ELSE 'aligned' END AS crowd FROM x"""


def unit_forms(s, d):
    c = F.col
    venue, kind = scores.market_parts(c("name"))
    b = hourly(s, d).withColumns({"n": F.row_number().over(auction.by_time()), "qty": c("volume").cast("double")})
    b = b.withColumn("name", F.concat(F.upper("symbol"), F.element_at(F.array(*map(F.lit, ("Linear", " Spot", "Inverse", ""))), c("n") % 4 + 1)))
    inverse, quote, size = c("n") % 2 == 0, c("n") % 3 == 0, F.when(c("n") % 5 > 0, F.lit(10.0))
    unit = F.element_at(F.array(*map(F.lit, ("base", "quote", "contracts"))), c("n") % 3 + 1)
    return b.select(
        "symbol", "bucket", scores.add_steps(c("volume"), c("delta"), F.lit(5)).alias("moved"), F.round(scores.quantity(c("qty"), c("close"), inverse, size, quote), 6).alias("qty"),
        F.round(scores.raw_quantity(c("qty"), c("close"), unit, inverse, size, quote), 6).alias("raw_qty"), scores.percent_text(c("delta") / 7.0).alias("pct"), scores.utc_text(c("bucket")).alias("utc"),
        venue.alias("venue"), kind.alias("kind"), scores.display_symbol(c("symbol"), F.when(c("n") % 3 == 0, F.lit("SHOWN")), c("n") % 2 == 0).alias("shown"),
    )


UNIT_SQL = f"""WITH {B}, x AS (SELECT *, row_number() OVER {ORDER} AS n, volume::DOUBLE AS q FROM b), y AS (SELECT *, n % 2 = 0 AS inv, n % 3 = 0 AS quo, CASE WHEN n % 5 > 0 THEN 10::DOUBLE END AS size, ['Linear', ' Spot', 'Inverse', ''][n % 4 + 1] AS suffix FROM x)
SELECT symbol, bucket, volume + delta * 5 AS moved, round(CASE WHEN size IS NOT NULL AND inv THEN CASE WHEN quo THEN q * size ELSE q END WHEN quo THEN q * coalesce(size, 1) * close ELSE q * coalesce(size, 1) END, 6) AS qty,
round(CASE WHEN inv OR quo THEN CASE n % 3 WHEN 0 THEN q * close WHEN 1 THEN q ELSE CASE WHEN inv THEN q * coalesce(size, 1) ELSE q * coalesce(size, 1) * close END END
ELSE CASE n % 3 WHEN 0 THEN q WHEN 1 THEN q / close ELSE q * coalesce(size, 1) END END, 6) AS raw_qty, CASE WHEN delta > 0 THEN printf('+%.2f%%', delta / 7) ELSE printf('%.2f%%', delta / 7) END AS pct,
strftime(make_timestamp(bucket * 1000), '%Y-%m-%d %H:%M:%S') AS utc, upper(symbol) AS venue, nullif(lower(trim(suffix)), '') AS kind, CASE WHEN n % 3 = 0 THEN 'SHOWN' WHEN n % 2 = 0 THEN symbol || 'USDT' ELSE symbol END AS shown FROM y"""


def sessions(s, d):
    days = bar_op.time_bars(trades(s, d), DAY).select("symbol", (F.col("bucket") / DAY).cast("long").alias("day"), "low", "high", "close")
    third = (F.col("high") - F.col("low")) / 3
    return days.withColumns({"value_low": F.col("low") + third, "value_high": F.col("high") - third})


def daily_bias(s, d):
    b = auction.daily_bias(hourly(s, d), sessions(s, d))
    location = F.when(F.col("close") > F.col("session_open"), "above_value").when(F.col("close") < F.col("session_open"), "below_value")
    factor = scores.bias_factor(location, F.when(F.col("volume") % 3 == 0, "above_value"), F.col("delta") > 0)
    return b.select("symbol", "bucket", "session_open", "bias", factor.alias("factor"))


BIAS_SQL = f"""WITH {B}, {bars_sql('e', DAY)}, p AS (SELECT symbol, bucket // {DAY} AS day, low, high, low + (high - low) / 3 AS vl, high - (high - low) / 3 AS vh FROM e), q AS (SELECT *, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS nxt FROM p),
x AS (SELECT b.*, q.low AS pl, q.high AS ph, q.vl, q.vh, row_number() OVER w AS rn, first_value(b.open) OVER w AS session_open FROM b LEFT JOIN q ON q.symbol = b.symbol AND q.nxt = b.bucket // {DAY} WINDOW w AS (PARTITION BY b.symbol, b.bucket // {DAY} ORDER BY b.bucket)),
y AS (SELECT *, coalesce(bool_or(rn > 1 AND (low <= vh AND high >= vl OR open BETWEEN vl AND vh)) OVER (PARTITION BY symbol, bucket // {DAY} ORDER BY bucket), false) AS acc FROM x),
z AS (SELECT *, CASE WHEN close > session_open THEN 'above_value' WHEN close < session_open THEN 'below_value' END AS w, CASE WHEN volume % 3 = 0 THEN 'above_value' END AS m, CASE WHEN delta > 0 THEN 'above_value' ELSE 'below_value' END AS l FROM y),
f AS (SELECT *, coalesce((w = l)::INT, 0) + coalesce((m = l)::INT, 0) AS al, coalesce((w <> l)::INT, 0) + coalesce((m <> l)::INT, 0) AS ag FROM z)
SELECT symbol, bucket, session_open, CASE WHEN pl IS NULL THEN NULL WHEN session_open BETWEEN vl AND vh THEN 'inside_value' WHEN acc THEN 'fade_gap' WHEN session_open > pl AND session_open < ph THEN 'outside_value' ELSE 'trend_day' END AS bias,
CASE WHEN al > 0 AND ag = 0 THEN 1.08::DOUBLE WHEN al > 0 THEN 1.03::DOUBLE WHEN ag > 0 THEN 0.9::DOUBLE ELSE 1 END AS factor FROM f"""


def edges(s, d):
    scaled = state(s, d).select("symbol", "bucket", *[(F.col(c) * 1e8).alias(c) for c in ("value_high", "value_low", "atr")], "cvd_slope")
    return auction.edge_absorption(hourly_cells(s, d), scaled)


def hourly_cells(s, d):
    return bar_op.footprint(trades(s, d), HOUR, WIDE)


def books(s, d):
    """Books from the trades of six hours: sells rest as bids, buys as asks above them."""
    pair = F.struct((F.col("price") + F.when(F.col("is_sell"), 0.0).otherwise(1000.0)).alias("price"), F.col("qty").cast("double").alias("qty"))
    side = lambda sell: F.sort_array(F.collect_list(F.when(F.col("is_sell") == sell, pair)), asc=not sell)
    t = trades(s, d).groupBy("symbol", (F.col("ts_ms") - F.col("ts_ms") % (6 * HOUR)).alias("ts_ms")).agg(side(True).alias("bids"), side(False).alias("asks"))
    near, wide = depth.near_liquidity(5), depth.range_liquidity("bids", F.lit(5.0), F.lit(60.0))
    return t.select("symbol", "ts_ms", *[near[k].alias(k) for k in ("near_bid", "near_ask", "max_bid", "max_ask")], *[wide[k].alias(k) for k in ("total", "wall_price", "wall_qty")])


def level_runs(s, d):
    u = trades(s, d).select("symbol", "ts_ms", "seq", (F.floor(F.col("price_units") / WIDE) * WIDE).cast("long").alias("level"), (F.col("qty") % 4 + 1).alias("qty"), (~F.col("is_sell")).alias("is_bid"))
    start = F.col("ts_ms") - F.col("ts_ms") % HOUR
    return u.select("symbol", "level", "is_bid", start.alias("start"), (start + F.col("qty") * HOUR).alias("until"), "qty")


RUN_SQL = f"""{T}, r AS (SELECT symbol, CAST(floor(price_units / {WIDE}) * {WIDE} AS BIGINT) AS level, NOT is_sell AS is_bid, ts_ms - ts_ms % {HOUR} AS start, ts_ms - ts_ms % {HOUR} + (qty % 4 + 1) * {HOUR} AS until, qty % 4 + 1 AS qty FROM t)"""
FROM, TO = 1_704_067_200_000 + 5 * DAY, 1_704_067_200_000 + 9 * DAY


def costed(s, d):
    c = F.col
    closed = {"gross": (c("price") - 50) * c("qty") / 100, "fees": c("qty") * c("price") * 0.0004, "funding": c("qty") * 0.001, "slippage": F.abs(c("price") - F.round("price")) * c("qty") / 100}
    return reports.costs(trades(s, d).withColumns(closed), "symbol")


def signal_days(s, d):
    rows = outcomes(s, d).withColumns({"day": F.floor(F.col("ts_ms") / DAY).cast("long"), "r": F.when(F.col("qty") % 4 > 0, F.col("r"))})
    return reports.signal_summary(rows, "symbol", "day")


def bands(s, d):
    return reports.by_band(outcomes(s, d), "score", {"low": (None, 0.3), "middle": (0.3, 0.75), "high": (0.75, None)}, "symbol")


def tick_pocs(s, d):
    return bar_op.tick_poc_status(trades(s, d), 50, WIDE)


def tick_vwap(s, d):
    return rounded(bar_op.tick_vwap(trades(s, d), 50), "vwap")


TICKS = f"""{T}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq) - 1) // 50 AS bar FROM t)"""


QUERIES = {f"setup_{name}": setup_query(name) for name in setups.SETUPS} | {
    "score_rules": (score_rules, SCORE_SQL),
    "unit_forms": (unit_forms, UNIT_SQL),
    "daily_bias": (daily_bias, BIAS_SQL),
    "failed_acceptance": (
        lambda s, d: auction.failed_acceptance(state(s, d)).select("symbol", "bucket", "failed", "absorption"),
        f"""WITH {S}, x AS (SELECT *, list({{'h': high, 'l': low, 'd': delta}}) OVER {last(2)} AS b FROM s0), y AS (SELECT *, CASE WHEN close < value_high THEN list_filter(b, lambda v: v.h > value_high)[-1].d END AS u, CASE WHEN close > value_low THEN list_filter(b, lambda v: v.l < value_low)[-1].d END AS w FROM x)
SELECT symbol, bucket, u IS NOT NULL OR w IS NOT NULL AS failed, CASE WHEN u IS NOT NULL THEN CASE WHEN u > 0 AND cvd_slope <= 0 THEN 'ask' ELSE 'none' END WHEN w < 0 AND cvd_slope >= 0 THEN 'bid' ELSE 'none' END AS absorption FROM y""",
    ),
    "edge_absorption": (
        edges,
        f"""WITH {S}, {FOOT_H.removeprefix(T + ", ")}, x AS (SELECT f.symbol, f.bucket, CAST(sum(CASE WHEN level >= (value_high * 1e8 - 0.35::DOUBLE * (atr * 1e8)) THEN f.buy_qty - f.sell_qty ELSE 0 END) AS BIGINT) AS at_high,
CAST(sum(CASE WHEN level <= (value_low * 1e8 + 0.35::DOUBLE * (atr * 1e8)) THEN f.buy_qty - f.sell_qty ELSE 0 END) AS BIGINT) AS at_low, first(atr) AS atr, first(cvd_slope) AS sl FROM f JOIN s0 USING (symbol, bucket) GROUP BY 1, 2)
SELECT symbol, bucket, at_high, at_low, CASE WHEN atr <= 0 THEN 'unknown' WHEN at_high > 0 AND sl <= 0.05::DOUBLE THEN 'ask' WHEN at_low < 0 AND sl >= -0.05::DOUBLE THEN 'bid' ELSE 'none' END AS side FROM x""",
    ),
    "one_sided_gap": (
        lambda s, d: auction.one_sided_gap(hourly_cells(s, d), 2),
        f"""WITH {FOOT_H}, k AS (SELECT symbol, bucket, array_to_string(list(CASE WHEN sell_qty <= 0 AND buy_qty > 0 THEN 'b' WHEN buy_qty <= 0 AND sell_qty > 0 THEN 's' ELSE '-' END ORDER BY level), '') AS p FROM f GROUP BY 1, 2), i AS (SELECT *, instr(p, 'bb') AS b, instr(p, 'ss') AS s FROM k)
SELECT symbol, bucket, CASE WHEN len(p) < 2 THEN 'unknown' WHEN b > 0 AND (s = 0 OR b < s) THEN 'bullish' WHEN s > 0 THEN 'bearish' ELSE 'none' END AS side FROM i""",
    ),
    "halves_divergence": (
        lambda s, d: state(s, d).withColumn("cvd_slope", F.col("cvd_slope") * 10).select("symbol", "bucket", auction.halves_divergence().alias("divergence")),
        f"""WITH {S}, x AS (SELECT *, cvd_slope * 10 AS sl, count(*) OVER {last(9)} AS k, max(high) OVER {last(9, '5 PRECEDING')} AS h1, max(high) OVER {last(4)} AS h2, min(low) OVER {last(9, '5 PRECEDING')} AS l1, min(low) OVER {last(4)} AS l2 FROM s0)
SELECT symbol, bucket, CASE WHEN k >= 10 AND h2 > h1 * 1.0001::DOUBLE AND sl < -0.5::DOUBLE THEN 'bearish' WHEN k >= 10 AND l2 < l1 * 0.9999::DOUBLE AND sl > 0.5::DOUBLE THEN 'bullish' END AS divergence FROM x""",
    ),
    "swing_divergence": (
        lambda s, d: rounded(auction.swing_divergence(state(s, d)).select("symbol", "bucket", "divergence", "strength", F.col("bars_ago").cast("long").alias("bars_ago"), "level"), "strength"),
        f"""WITH {S}, l AS (SELECT *, list({{'h': high, 'l': low, 'c': cvd}}) OVER {last(29)} AS b FROM s0), k AS (SELECT *, list_avg([abs(v.c) FOR v IN b]) AS size,
list_filter(range(3, len(b)), lambda i: b[i].h >= b[i - 1].h AND b[i].h >= b[i - 2].h AND b[i].h >= b[i + 1].h) AS hs, list_filter(range(3, len(b)), lambda i: b[i].l <= b[i - 1].l AND b[i].l <= b[i - 2].l AND b[i].l <= b[i + 1].l) AS ls FROM l),
g AS (SELECT *, CASE WHEN len(b) >= 30 AND size >= 1e-9 AND len(hs) > 1 AND b[hs[-1]].h >= b[hs[-2]].h AND b[hs[-1]].c < b[hs[-2]].c THEN (b[hs[-2]].c - b[hs[-1]].c) / size END AS u0,
CASE WHEN len(b) >= 30 AND size >= 1e-9 AND len(ls) > 1 AND b[ls[-1]].l <= b[ls[-2]].l AND b[ls[-1]].c > b[ls[-2]].c THEN (b[ls[-1]].c - b[ls[-2]].c) / size END AS w0 FROM k),
j AS (SELECT *, CASE WHEN u0 >= 0.1::DOUBLE THEN u0 END AS u, CASE WHEN w0 >= 0.1::DOUBLE THEN w0 END AS w FROM g), e AS (SELECT *, CASE WHEN u IS NOT NULL AND (w IS NULL OR u >= w) THEN 'bearish' WHEN w IS NOT NULL THEN 'bullish' END AS divergence FROM j)
SELECT symbol, bucket, divergence, round(greatest(u, w), 6) AS strength, CASE divergence WHEN 'bearish' THEN len(b) - hs[-1] WHEN 'bullish' THEN len(b) - ls[-1] END AS bars_ago, CASE divergence WHEN 'bearish' THEN b[hs[-1]].h WHEN 'bullish' THEN b[ls[-1]].l END AS level FROM e""",
    ),
    "streak_context": (
        lambda s, d: auction.streak_context(state(s, d)).select("symbol", "bucket", *[F.col(c).cast("long").alias(c) for c in ("run_negative", "run_positive", "prev_delta", "since_quiet")]),
        f"""WITH {S}, x AS (SELECT *, max(CASE WHEN delta >= 0 THEN n END) OVER w AS a, max(CASE WHEN delta <= 0 THEN n END) OVER w AS p, max(CASE WHEN vr < 0.7::DOUBLE THEN n END) OVER w AS q, lag(delta, 1, 0) OVER w AS prev_delta FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY bucket))
SELECT symbol, bucket, n - coalesce(a, 0) AS run_negative, n - coalesce(p, 0) AS run_positive, CAST(prev_delta AS BIGINT) AS prev_delta, least(coalesce(n - q, 9999), 9999) AS since_quiet FROM x""",
    ),
    "stress_ranges": (
        lambda s, d: numbered_bars(s, d).select("symbol", "bucket", *[c.alias(k) for c, k in zip(auction.stress_ranges(), ("stress", "calming"), strict=True)]),
        f"WITH {B}, x AS (SELECT *, high - low AS z, avg(high - low) OVER {last(19, '1 PRECEDING')} AS m FROM b) SELECT symbol, bucket, coalesce(z > 2 * m, false) AS stress, coalesce(z < 1.5::DOUBLE * m, false) AS calming FROM x",
    ),
    "book_liquidity": (
        books,
        f"""WITH {T}, g AS (SELECT symbol, ts_ms - ts_ms % {6 * HOUR} AS ts_ms, coalesce(list({{'p': price, 'q': qty::DOUBLE}} ORDER BY price DESC, qty DESC) FILTER (is_sell), []) AS b, coalesce(list({{'p': price + 1000, 'q': qty::DOUBLE}} ORDER BY price, qty) FILTER (NOT is_sell), []) AS a FROM t GROUP BY 1, 2),
x AS (SELECT *, len(b) >= 5 AND len(a) >= 5 AS ok, [v.q FOR v IN b[:5]] AS nb, [v.q FOR v IN a[:5]] AS na, list_filter(b, lambda v: v.p >= 5 AND v.p <= 60) AS r FROM g), y AS (SELECT *, list_max([v.q FOR v IN r]) AS w FROM x)
SELECT symbol, ts_ms, CASE WHEN ok THEN list_sum(nb) ELSE 0 END AS near_bid, CASE WHEN ok THEN list_sum(na) ELSE 0 END AS near_ask, CASE WHEN ok THEN list_max(nb) ELSE 0 END AS max_bid, CASE WHEN ok THEN list_max(na) ELSE 0 END AS max_ask,
coalesce(list_sum([v.q FOR v IN r]), 0)::DOUBLE AS total, coalesce(list_min([v.p FOR v IN r IF v.q = w]), 0)::DOUBLE AS wall_price, coalesce(w, 0)::DOUBLE AS wall_qty FROM y""",
    ),
    "runs_latest": (
        lambda s, d: depth.latest_runs(level_runs(s, d), WIDE, 20 * WIDE, FROM),
        f"WITH {RUN_SQL} SELECT * FROM r WHERE level BETWEEN {WIDE} AND {20 * WIDE} QUALIFY row_number() OVER (PARTITION BY symbol, level ORDER BY start DESC, until DESC, qty DESC, is_bid DESC) = 1 AND until >= {FROM}",
    ),
    "runs_kept": (lambda s, d: depth.kept_runs(level_runs(s, d), FROM), f"WITH {RUN_SQL} SELECT * FROM r WHERE until >= {FROM}"),
    "runs_largest": (
        lambda s, d: depth.largest_runs(level_runs(s, d), FROM, TO, WIDE, 20 * WIDE, 20.0),
        f"""WITH {RUN_SQL} SELECT symbol, max(qty) AS max_qty, coalesce(max(qty) FILTER (qty * (level / 1e8) > 20), 0) AS max_sized FROM r WHERE until >= {FROM} AND start <= {TO} AND level BETWEEN {WIDE} AND {20 * WIDE} GROUP BY 1""",
    ),
    "level_lookup": (
        lambda s, d: bar_op.level_lookup(hourly_cells(s, d), hourly(s, d).select("symbol", "bucket", (F.floor(F.col("close") / 5) * WIDE).cast("long").alias("level"))),
        f"""WITH {FOOT_H}, q AS (SELECT symbol, ts_ms - ts_ms % {HOUR} AS bucket, CAST(floor(last(price ORDER BY ts_ms, seq) / 5) * {WIDE} AS BIGINT) AS level FROM t GROUP BY 1, 2)
SELECT q.symbol, q.bucket, q.level, coalesce(f.buy_qty, 0) AS buy_qty, coalesce(f.sell_qty, 0) AS sell_qty FROM q LEFT JOIN f USING (symbol, bucket, level)""",
    ),
    "footprint_largest": (
        lambda s, d: bar_op.largest_in(cells(s, d), FROM, TO, WIDE, 20 * WIDE),
        f"""WITH {FOOT}, x AS (SELECT * FROM f WHERE bucket BETWEEN {FROM} AND {TO}), v AS (SELECT symbol, bucket, sum(buy_qty + sell_qty) AS v FROM x GROUP BY 1, 2)
SELECT symbol, max(greatest(buy_qty, sell_qty)) FILTER (level BETWEEN {WIDE} AND {20 * WIDE}) AS max_side, max(abs(buy_qty - sell_qty)) FILTER (level BETWEEN {WIDE} AND {20 * WIDE}) AS max_delta, max(buy_qty + sell_qty) FILTER (level BETWEEN {WIDE} AND {20 * WIDE}) AS max_volume,
max(greatest(buy_qty, sell_qty)) AS max_cell, (SELECT CAST(max(v.v) AS BIGINT) FROM v WHERE v.symbol = x.symbol) AS max_bar FROM x GROUP BY 1""",
    ),
    "cluster_scale": (
        lambda s, d: rounded(bar_op.cluster_scale(cells(s, d), "volume", 0.25), "hybrid"),
        f"""WITH {FOOT}, x AS (SELECT symbol, bucket, max(buy_qty + sell_qty) AS own FROM f GROUP BY 1, 2), y AS (SELECT *, max(own) OVER (PARTITION BY symbol) AS seen FROM x)
SELECT symbol, bucket, own, seen, round(CASE WHEN 0.25::DOUBLE * seen + 0.75::DOUBLE * own <= 0 THEN 1 ELSE 0.25::DOUBLE * seen + 0.75::DOUBLE * own END, 6) AS hybrid FROM y""",
    ),
    "tick_naked_poc": (
        tick_pocs,
        f"""WITH {TICKS}, f AS (SELECT symbol, bar, (price_units + {WIDE // 2}) // {WIDE} * {WIDE} AS level, sum(qty) AS q FROM k GROUP BY 1, 2, 3), p AS (SELECT symbol, bar, first(level ORDER BY q DESC, level) AS poc FROM f GROUP BY 1, 2),
b AS (SELECT symbol, bar, CAST(floor(min(price_units) / {WIDE}) * {WIDE} AS BIGINT) AS lo, CAST(ceil(max(price_units) / {WIDE}) * {WIDE} AS BIGINT) AS hi FROM k GROUP BY 1, 2), l AS (SELECT symbol, max(bar) AS last FROM b GROUP BY 1),
h AS (SELECT p.symbol, p.bar, p.poc, min(b.bar) AS filled FROM p LEFT JOIN b ON b.symbol = p.symbol AND b.bar > p.bar AND p.poc BETWEEN b.lo AND b.hi GROUP BY 1, 2, 3)
SELECT symbol, bar, poc, last - filled AS filled_from_last, CASE WHEN filled IS NOT NULL THEN 'filled' WHEN bar < last THEN 'naked' ELSE 'none' END AS status FROM h JOIN l USING (symbol)""",
    ),
    "tick_vwap": (
        tick_vwap,
        f"""WITH {TICKS}, b AS (SELECT symbol, bar, min(ts_ms) AS start, max(price) AS h, min(price) AS l, last(price ORDER BY ts_ms, seq) AS c, sum(qty) AS v FROM k GROUP BY 1, 2)
SELECT symbol, bar, round(sum((h + l + c) / 3 * v) OVER w / sum(v) OVER w, 6) AS vwap FROM b WINDOW w AS (PARTITION BY symbol, start // {DAY} ORDER BY bar)""",
    ),
    "report_costs": (
        costed,
        f"""WITH {T}, x AS (SELECT symbol, (price - 50) * qty / 100 AS gross, qty * price * 0.0004::DOUBLE AS fees, qty * 0.001::DOUBLE AS funding, abs(price - round(price)) * qty / 100 AS slip FROM t), g AS (SELECT symbol, sum(gross) AS gross, sum(fees) AS fees, sum(funding) AS funding, sum(slip) AS slippage FROM x GROUP BY 1)
SELECT symbol, round(gross, 4) AS gross, round(fees, 4) AS fees, round(funding, 4) AS funding, round(slippage, 4) AS slippage, round((fees + funding + slippage) / abs(gross) * 100, 4) AS cost_pct, round((gross - fees - funding - slippage) / abs(gross) * 100, 4) AS net_pct FROM g""",
    ),
    "report_signal_days": (
        signal_days,
        f"""WITH {T}, x AS (SELECT symbol, ts_ms // {DAY} AS day, CASE WHEN qty % 4 > 0 THEN CAST(round(price * 100) AS BIGINT) % 7 / 2.0 - 1.25 END::DOUBLE AS r FROM t)
SELECT symbol, day, count(*) AS total, count(r) AS closed, count(*) - count(r) AS open, round(count(*) FILTER (r > 0) / nullif(count(r), 0), 6) AS win_rate, round(avg(r), 6) AS avg_r, round(sum(r), 6) AS total_r FROM x GROUP BY 1, 2""",
    ),
    "report_bands": (
        bands,
        f"""WITH {T}, x AS (SELECT symbol, qty / 100.0 AS v, CAST(round(price * 100) AS BIGINT) % 7 / 2.0 - 1.25 AS r FROM t)
SELECT symbol, CASE WHEN v < 0.3 THEN 'low' WHEN v <= 0.75 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(count(*) FILTER (r > 0) / count(*), 6) AS win_rate, round(avg(r), 6) AS avg_r FROM x GROUP BY 1, 2""",
    ),
    "report_discrimination": (
        lambda s, d: reports.discrimination(outcomes(s, d), "symbol"),
        f"""WITH {T}, x AS (SELECT symbol, qty / 100.0::DOUBLE AS score, CAST(round(price * 100) AS BIGINT) % 7 / 2.0::DOUBLE - 1.25::DOUBLE AS r FROM t)
SELECT symbol, round(avg(score) FILTER (r > 0), 6) AS winners, round(avg(score) FILTER (r <= 0), 6) AS losers, round(CASE WHEN count(*) >= 30 THEN corr(score, r) END, 6) AS r FROM x GROUP BY 1""",
    ),
    "report_contradictions": (
        lambda s, d: reports.contradictions(trades(s, d)),
        f"WITH {T}, x AS (SELECT *, lag(is_sell) OVER (PARTITION BY symbol, ts_ms // {DAY} ORDER BY ts_ms, seq) AS before FROM t) SELECT symbol, ts_ms // {DAY} AS day, count(*) AS signals, count(*) FILTER (before <> is_sell) AS contradictions FROM x GROUP BY 1, 2",
    ),
    "report_storage": (
        lambda s, d: cells(s, d).groupBy("symbol").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("buy_qty") + F.col("sell_qty")).alias("qty")),
        f"WITH {FOOT} SELECT f.symbol, (SELECT min(ts_ms) FROM t WHERE t.symbol = f.symbol) AS first_ms, (SELECT max(ts_ms) FROM t WHERE t.symbol = f.symbol) AS last_ms, count(*) AS cells, CAST(sum(buy_qty + sell_qty) AS BIGINT) AS qty FROM f GROUP BY 1",
    ),
}
