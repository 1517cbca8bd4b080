"""Registered queries: indicators, structure and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.clocks import DAY, HOUR, MINUTE
from ..operators import indicators as op
from ..operators import profile, recursive, structure
from ..sources.trades import trades
from .base import STEP, WIDE, B, N, T, hourly, numbered_bars, rounded

W = "(PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {} PRECEDING AND {})"
DAYW = f"(PARTITION BY symbol, bucket // {DAY} ORDER BY bucket ROWS UNBOUNDED PRECEDING)"


def back(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def ahead(a: int, b: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


ORDER = "(PARTITION BY symbol ORDER BY bucket)"
ALL = "(PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING)"


def vwap_bands(s, d):
    out = op.session_vwap(hourly(s, d)).select("symbol", "bucket", "vwap", "upper1", "lower1", "upper2", "lower2")
    return rounded(out, "vwap", "upper1", "lower1", "upper2", "lower2", digits=4)


def cvd_slopes(s, d):
    b = op.cvd(numbered_bars(s, d), daily=False).withColumn("slope20", op.slope("cvd", 20, 3)).withColumn("slope5", op.slope("cvd", 5, 5))
    return rounded(b.select("symbol", "bucket", "cvd", "slope20", "slope5"), "slope20", "slope5")


def volume_ratios(s, d):
    b = hourly(s, d).select("symbol", "bucket", op.ratio_to_previous(20).alias("previous20"), op.ratio_to_previous(49).alias("previous49"), op.ratio_with_current(50).alias("with50"), op.ratio_with_current(50, 10).alias("with50_from10"))
    return rounded(b, "previous20", "previous49", "with50", "with50_from10")


def vpins(s, d):
    b = hourly(s, d).withColumn("bar", op.bar_vpin())
    b = b.select("symbol", "bucket", op.vpin_share().alias("share20"), op.vpin_mean().alias("mean50"), op.buy_share().alias("buy50"), "bar", op.empirical_share(F.col("bar")).alias("cdf50"))
    return rounded(b, "share20", "mean50", "buy50", "bar", "cdf50")


def delta_scores(s, d):
    b = hourly(s, d).select("symbol", "bucket", op.z_score("delta", 50, 3).alias("z50_3"), op.z_score("delta", 50, 5).alias("z50_5"), op.z_score("delta", 100, 20, False).alias("z100_20"))
    return rounded(b, "z50_3", "z50_5", "z100_20")


def streaks(s, d):
    b = op.cvd(hourly(s, d))
    b = op.run_length(b, F.signum("delta").cast("int"), "delta_run")
    b = b.withColumn("_d", op.divergence_sign())
    return op.run_length(b, F.col("_d"), "divergence_run").select("symbol", "bucket", "delta_run", "divergence_run")


def efficiency(s, d):
    b = numbered_bars(s, d).select("symbol", "bucket", op.efficiency(10).alias("efficiency"), op.choppiness().alias("choppiness"), op.reversals(10).alias("reversals"), op.atr_mean().alias("atr"))
    return rounded(b, "efficiency", "choppiness", "atr")


def liquidations(s, d):
    t = trades(s, d).select("symbol", "ts_ms", "seq", "is_sell", (F.col("price") * F.col("qty")).alias("usd"))
    return rounded(op.trailing_sums(t, 4 * HOUR, HOUR, 2500.0, 0.6), "sells", "buys", digits=4)


def forward(s, d):
    b = op.forward_returns(hourly(s, d), (1, 5, 15), 15).select("symbol", "bucket", "fwd_1", "fwd_5", "fwd_15", "mfe", "mae")
    return rounded(b, "fwd_1", "fwd_5", "fwd_15", "mfe", "mae", digits=4)


def rolling_quantiles(s, d):
    w = op.rows(-23)
    full = F.count("close").over(w) >= 12
    b = hourly(s, d).select("symbol", "bucket", *[F.when(full, F.percentile("close", p).over(w)).alias(n) for p, n in ((0.15, "q15"), (0.9, "q90"))])
    return rounded(b, "q15", "q90")


def open_interest(s, d):
    oi = op.cvd(hourly(s, d), daily=False).withColumn("oi", F.col("cvd") + 100_000)
    oi = oi.withColumn("oi_delta", F.col("oi") - F.lag("oi").over(op.by_time()))
    trend = (F.col("oi") / F.lag("oi", 5).over(op.by_time()) - 1) * 100
    out = oi.select("symbol", "bucket", "oi_delta", trend.alias("change"), op.z_score("oi_delta", 20, 2).alias("z"))
    name = F.when(F.col("change") > 1.0, "fast_up").when(F.col("change") > 0.3, "up").when(F.col("change") < -1.0, "fast_down").when(F.col("change") < -0.3, "down").otherwise("flat")
    return rounded(out.withColumn("trend", name), "change", "z")


def emas(s, d):
    return rounded(recursive.ema(hourly(s, d).select("symbol", "bucket", "close"), "close", 20, "ema20").select("symbol", "bucket", "ema20"), "ema20")


def atrs(s, d):
    b = recursive.wilder_atr_seeded(recursive.wilder_atr(numbered_bars(s, d)))
    return rounded(b.select("symbol", "bucket", "atr", "atr_seeded"), "atr", "atr_seeded")


def pressures(s, d):
    b = recursive.pressure(hourly(s, d), scalars.imbalance(F.col("buy_qty"), F.col("sell_qty")))
    return rounded(b.select("symbol", "bucket", "pressure"), "pressure")


def fold_sql(value: str, start: str, step: str, name: str, source: str = "b") -> str:
    """A recursion over numbered rows; DuckDB runs it as one."""
    return f"""WITH RECURSIVE {N}, x AS (SELECT symbol, bucket, n, {value} AS x FROM n),
f(symbol, bucket, n, s) AS (SELECT symbol, bucket, n, CAST({start} AS DOUBLE) FROM x WHERE n = 1
UNION ALL SELECT x.symbol, x.bucket, x.n, CAST({step} AS DOUBLE) FROM f JOIN x ON x.symbol = f.symbol AND x.n = f.n + 1)
SELECT symbol, bucket, round(s, 6) AS {name} FROM f"""


def pivots(s, d):
    b = structure.confirmed_swings(hourly(s, d), 2, 2)
    b = structure.breaks(b)
    return b.select("symbol", "bucket", "swing_high", "swing_low", "known_at", "last_swing_high", "last_swing_low", "break_side", "bias_before", "structure")


def extremes(s, d):
    return structure.equal_extremes(hourly(s, d), 50, 0.02).select("symbol", "bucket", "roll_high", "roll_low", "prior_high", "prior_low", "equal_high", "equal_low", "swept_high", "swept_low")


def regimes(s, d):
    return rounded(structure.regime(numbered_bars(s, d)).select("symbol", "bucket", "slow", "fast", "spread", "regime"), "slow", "fast", "spread")


def day_levels(s, d):
    return profile.day_profile(trades(s, d), STEP)


def prints(s, d):
    from ..operators.bars import time_bars

    return profile.single_prints(time_bars(trades(s, d), 30 * MINUTE), WIDE)


PROFILE = f"{T}, p AS (SELECT symbol, ts_ms // {DAY} AS day, price_units // {STEP} * {STEP} AS level, CAST(sum(qty) AS BIGINT) AS qty FROM t GROUP BY 1, 2, 3)"

QUERIES = {
    "vwap_session_bands": (
        vwap_bands,
        f"""WITH {B}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
y AS (SELECT symbol, bucket, coalesce(sum(tp * volume) OVER {DAYW} / nullif(sum(volume) OVER {DAYW}, 0), close) AS vwap, sum(tp * tp * volume) OVER {DAYW} / nullif(sum(volume) OVER {DAYW}, 0) AS m2 FROM x),
z AS (SELECT symbol, bucket, vwap, sqrt(greatest(0, coalesce(m2 - vwap * vwap, 0))) AS s FROM y)
SELECT symbol, bucket, round(vwap, 4) AS vwap, round(vwap + s, 4) AS upper1, round(vwap - s, 4) AS lower1, round(vwap + 2 * s, 4) AS upper2, round(vwap - 2 * s, 4) AS lower2 FROM z""",
    ),
    "vwap_sessions": (
        lambda s, d: rounded(op.session_vwaps(hourly(s, d)).select("symbol", "bucket", "vwap_asia", "vwap_london", "vwap_new_york"), "vwap_asia", "vwap_london", "vwap_new_york"),
        f"""WITH {B}, x AS (SELECT *, (high + low + close) / 3 AS tp, bucket % {DAY} // {HOUR} AS h FROM b),
y AS (SELECT *, h < 8 AS a, h >= 8 AND h < 16 AS l, h >= 13 AND h < 21 AS u FROM x)
SELECT symbol, bucket,
CASE WHEN a THEN round(sum(tp * volume) OVER wa / nullif(sum(volume) OVER wa, 0), 6) END AS vwap_asia,
CASE WHEN l THEN round(sum(tp * volume) OVER wl / nullif(sum(volume) OVER wl, 0), 6) END AS vwap_london,
CASE WHEN u THEN round(sum(tp * volume) OVER wu / nullif(sum(volume) OVER wu, 0), 6) END AS vwap_new_york FROM y
WINDOW wa AS (PARTITION BY symbol, bucket // {DAY}, a ORDER BY bucket), wl AS (PARTITION BY symbol, bucket // {DAY}, l ORDER BY bucket), wu AS (PARTITION BY symbol, bucket // {DAY}, u ORDER BY bucket)""",
    ),
    "cvd_daily": (
        lambda s, d: op.cvd(hourly(s, d)).select("symbol", "bucket", "delta", "cvd"),
        f"WITH {B} SELECT symbol, bucket, delta, CAST(sum(delta) OVER {DAYW} AS BIGINT) AS cvd FROM b",
    ),
    "cvd_slopes": (
        cvd_slopes,
        f"""WITH {N}, c AS (SELECT symbol, bucket, n, CAST(sum(delta) OVER {ALL} AS BIGINT) AS cvd FROM n)
SELECT symbol, bucket, cvd, CASE WHEN count(*) OVER {back(20)} >= 3 THEN round(regr_slope(cvd, n) OVER {back(20)}, 6) END AS slope20,
CASE WHEN count(*) OVER {back(5)} >= 5 THEN round(regr_slope(cvd, n) OVER {back(5)}, 6) END AS slope5 FROM c""",
    ),
    "vpin_variants": (
        vpins,
        f"""WITH {B}, x AS (SELECT *, abs(delta) / nullif(volume, 0) AS bar FROM b)
SELECT symbol, bucket, round(coalesce(sum(abs(delta)) OVER {back(20)} / nullif(sum(volume) OVER {back(20)}, 0) * 100, 0), 6) AS share20, round(avg(bar) OVER {back(50)}, 6) AS mean50,
round(CASE WHEN count(*) OVER {back(50)} >= 10 THEN coalesce(sum(buy_qty) OVER {back(50)} / nullif(sum(volume) OVER {back(50)}, 0), 0.5) ELSE 0.5 END, 6) AS buy50, round(bar, 6) AS bar,
CASE WHEN bar IS NOT NULL AND len(list_filter(list(bar) OVER {back(50)}, lambda v: v IS NOT NULL)) >= 3 THEN
round(len(list_filter(list(bar) OVER {back(50)}, lambda v: v <= bar)) / len(list_filter(list(bar) OVER {back(50)}, lambda v: v IS NOT NULL)), 6) END AS cdf50 FROM x""",
    ),
    "volume_ratios": (
        volume_ratios,
        f"""WITH {B} SELECT symbol, bucket, round(coalesce(volume / nullif(avg(volume) OVER {before(20)}, 0), 1), 6) AS previous20, round(coalesce(volume / nullif(avg(volume) OVER {before(49)}, 0), 1), 6) AS previous49,
round(volume / nullif(avg(volume) OVER {back(50)}, 0), 6) AS with50, CASE WHEN count(*) OVER {back(50)} >= 10 THEN round(volume / nullif(avg(volume) OVER {back(50)}, 0), 6) END AS with50_from10 FROM b""",
    ),
    "delta_z_scores": (
        delta_scores,
        f"""WITH {B}, x AS (SELECT *, avg(delta) OVER {back(50)} AS m, stddev_pop(delta) OVER {back(50)} AS s, count(*) OVER {back(50)} AS c,
avg(delta) OVER {back(100)} AS m1, stddev_samp(delta) OVER {back(100)} AS s1, count(*) OVER {back(100)} AS c1 FROM b)
SELECT symbol, bucket, CASE WHEN c >= 3 AND s >= 1e-9 THEN round((delta - m) / s, 6) ELSE 0 END AS z50_3, CASE WHEN c >= 5 AND s >= 1e-9 THEN round((delta - m) / s, 6) ELSE 0 END AS z50_5,
CASE WHEN c1 >= 20 AND s1 >= 1e-9 THEN round((delta - m1) / s1, 6) ELSE 0 END AS z100_20 FROM x""",
    ),
    "streaks": (
        streaks,
        f"""WITH {B}, c AS (SELECT *, CAST(sum(delta) OVER {DAYW} AS BIGINT) AS cvd FROM b),
g AS (SELECT *, sign(delta) AS s1, coalesce(CASE WHEN close > lag(close) OVER {ORDER} AND NOT cvd > lag(cvd) OVER {ORDER} THEN 1 WHEN NOT close > lag(close) OVER {ORDER} AND cvd > lag(cvd) OVER {ORDER} THEN -1 END, 0) AS s2 FROM c),
k AS (SELECT *, CAST(s1 <> coalesce(lag(s1) OVER {ORDER}, 99) AS INT) AS n1, CAST(s2 <> coalesce(lag(s2) OVER {ORDER}, 99) AS INT) AS n2 FROM g),
r AS (SELECT *, sum(n1) OVER {ALL} AS g1, sum(n2) OVER {ALL} AS g2 FROM k)
SELECT symbol, bucket, CAST(s1 * row_number() OVER (PARTITION BY symbol, g1 ORDER BY bucket) AS BIGINT) AS delta_run, CAST(s2 * row_number() OVER (PARTITION BY symbol, g2 ORDER BY bucket) AS BIGINT) AS divergence_run FROM r""",
    ),
    "efficiency_choppiness": (
        efficiency,
        f"""WITH {N}, x AS (SELECT *, CAST((close - prev_close) * (prev_close - lag(prev_close) OVER {ORDER}) < 0 AS INT) AS turn FROM n)
SELECT symbol, bucket, round(abs(close - lag(close, 10) OVER {ORDER}) / nullif(sum(abs(close - prev_close)) OVER {back(10)}, 0), 6) AS efficiency,
CASE WHEN count(*) OVER {back(14)} >= 14 AND max(high) OVER {back(14)} - min(low) OVER {back(14)} > 0 THEN round(100 * log10(sum(tr) OVER {back(14)} / (max(high) OVER {back(14)} - min(low) OVER {back(14)})) / log10(14), 6) END AS choppiness,
CAST(sum(turn) OVER {back(10)} AS BIGINT) AS reversals, round(avg(CASE WHEN prev_close IS NOT NULL THEN tr END) OVER {back(14)}, 6) AS atr FROM x""",
    ),
    "liquidation_windows": (
        liquidations,
        f"""WITH {T}, x AS (SELECT *, price * qty AS usd FROM t), y AS (SELECT symbol, ts_ms, seq,
coalesce(sum(usd) FILTER (is_sell) OVER w, 0) AS sells, coalesce(sum(usd) FILTER (NOT is_sell) OVER w, 0) AS buys, sum(usd) OVER v > 2500 AS cascade FROM x
WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {4 * HOUR} PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW))
SELECT symbol, ts_ms, seq, round(sells, 4) AS sells, round(buys, 4) AS buys, cascade, CASE WHEN sells > 0.6 * (sells + buys) THEN 'sell' WHEN buys > 0.6 * (sells + buys) THEN 'buy' ELSE 'none' END AS dominant FROM y""",
    ),
    "forward_returns": (
        forward,
        f"""WITH {B} SELECT symbol, bucket, round((lead(close) OVER {ORDER} / close - 1) * 1e4, 4) AS fwd_1, round((lead(close, 5) OVER {ORDER} / close - 1) * 1e4, 4) AS fwd_5, round((lead(close, 15) OVER {ORDER} / close - 1) * 1e4, 4) AS fwd_15,
round((max(high) OVER {ahead(1, 15)} / close - 1) * 1e4, 4) AS mfe, round((min(low) OVER {ahead(1, 15)} / close - 1) * 1e4, 4) AS mae FROM b""",
    ),
    "rolling_quantiles": (
        rolling_quantiles,
        f"WITH {B} SELECT symbol, bucket, CASE WHEN count(*) OVER {back(24)} >= 12 THEN round(quantile_cont(close, 0.15) OVER {back(24)}, 6) END AS q15, CASE WHEN count(*) OVER {back(24)} >= 12 THEN round(quantile_cont(close, 0.9) OVER {back(24)}, 6) END AS q90 FROM b",
    ),
    "open_interest": (
        open_interest,
        f"""WITH {B}, c AS (SELECT symbol, bucket, CAST(sum(delta) OVER {ALL} AS BIGINT) + 100000 AS oi FROM b),
x AS (SELECT *, oi - lag(oi) OVER {ORDER} AS oi_delta, (oi / lag(oi, 5) OVER {ORDER} - 1) * 100 AS change FROM c),
y AS (SELECT *, avg(oi_delta) OVER {back(20)} AS m, stddev_pop(oi_delta) OVER {back(20)} AS s, count(oi_delta) OVER {back(20)} AS k FROM x)
SELECT symbol, bucket, oi_delta, round(change, 6) AS change, CASE WHEN k >= 2 AND s >= 1e-9 THEN round((oi_delta - m) / s, 6) ELSE 0 END AS z,
CASE WHEN change > 1 THEN 'fast_up' WHEN change > 0.3::DOUBLE THEN 'up' WHEN change < -1 THEN 'fast_down' WHEN change < -0.3::DOUBLE THEN 'down' ELSE 'flat' END AS trend FROM y""",
    ),
    "ema": (emas, fold_sql("close", "x", "2.0::DOUBLE / 21 * x.x + (1 - 2.0::DOUBLE / 21) * f.s", "ema20")),
    "atr_wilder": (
        atrs,
        f"""WITH RECURSIVE {N},
f(symbol, bucket, n, s, q) AS (SELECT symbol, bucket, n, tr, tr FROM n WHERE n = 1
UNION ALL SELECT x.symbol, x.bucket, x.n, CASE WHEN x.n <= 14 THEN f.s + (x.tr - f.s) / x.n ELSE (13 * f.s + x.tr) / 14 END, (13 * f.q + x.tr) / 14 FROM f JOIN n x ON x.symbol = f.symbol AND x.n = f.n + 1)
SELECT symbol, bucket, round(s, 6) AS atr, round(q, 6) AS atr_seeded FROM f""",
    ),
    "market_pressure": (
        pressures,
        fold_sql("coalesce((buy_qty - sell_qty) / nullif(buy_qty + sell_qty, 0), 0)", "0.3::DOUBLE * x * 100", "0.7::DOUBLE * f.s + 0.3::DOUBLE * x.x * 100", "pressure"),
    ),
    "adx": (
        lambda s, d: rounded(recursive.adx(hourly(s, d)), "adx", digits=4),
        f"""WITH RECURSIVE {N}, m AS (SELECT *, high - lag(high) OVER {ORDER} AS up, lag(low) OVER {ORDER} - low AS down FROM n),
v AS (SELECT symbol, bucket, n, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS q FROM m),
f(symbol, bucket, n, p, q, t, i) AS (SELECT symbol, bucket, n, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE FROM v WHERE n = 1
UNION ALL SELECT symbol, bucket, n, p, q, t, CASE WHEN n <= 14 THEN NULL WHEN i IS NULL THEN dx ELSE (13 * i + dx) / 14 END FROM (
 SELECT *, coalesce(100 * abs(p - q) / nullif(p + q, 0), 0) AS dx FROM (
 SELECT v.symbol, v.bucket, v.n, CASE WHEN v.n <= 15 THEN f.p + v.p ELSE f.p - f.p / 14 + v.p END AS p, CASE WHEN v.n <= 15 THEN f.q + v.q ELSE f.q - f.q / 14 + v.q END AS q,
 CASE WHEN v.n <= 15 THEN f.t + v.tr ELSE f.t - f.t / 14 + v.tr END AS t, f.i FROM f JOIN v ON v.symbol = f.symbol AND v.n = f.n + 1)))
SELECT symbol, bucket, round(i, 4) AS adx FROM f""",
    ),
    "swings_and_breaks": (
        pivots,
        f"""WITH {B}, x AS (SELECT *, count(*) OVER {before(2)} = 2 AND count(*) OVER {ahead(1, 2)} = 2 AS full_, greatest(max(high) OVER {before(2)}, max(high) OVER {ahead(1, 2)}) AS hh, least(min(low) OVER {before(2)}, min(low) OVER {ahead(1, 2)}) AS ll, lead(bucket, 2) OVER {ORDER} AS known_at FROM b),
y AS (SELECT *, CASE WHEN full_ AND high > hh THEN high END AS swing_high, CASE WHEN full_ AND low < ll THEN low END AS swing_low FROM x),
z AS (SELECT *, lag(swing_high, 2) OVER {ORDER} AS kh, lag(swing_low, 2) OVER {ORDER} AS kl FROM y),
l AS (SELECT *, last_value(kh IGNORE NULLS) OVER {ALL} AS last_swing_high, last_value(kl IGNORE NULLS) OVER {ALL} AS last_swing_low FROM z),
k AS (SELECT *, CAST(CASE WHEN close > last_swing_high THEN 1 WHEN close < last_swing_low THEN -1 END AS INTEGER) AS break_side FROM l),
m AS (SELECT *, last_value(break_side IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bias_before FROM k)
SELECT symbol, bucket, swing_high, swing_low, known_at, last_swing_high, last_swing_low, break_side, bias_before, CASE WHEN break_side IS NULL THEN 'none' WHEN bias_before = -break_side THEN 'change' ELSE 'break' END AS structure FROM m""",
    ),
    "extremes_and_sweeps": (
        extremes,
        f"""WITH {B}, x AS (SELECT *, max(high) OVER {back(50)} AS roll_high, min(low) OVER {back(50)} AS roll_low FROM b),
y AS (SELECT *, lag(roll_high) OVER {ORDER} AS prior_high, lag(roll_low) OVER {ORDER} AS prior_low FROM x)
SELECT symbol, bucket, roll_high, roll_low, prior_high, prior_low, coalesce(abs(high - prior_high) <= prior_high * 0.02::DOUBLE, false) AS equal_high, coalesce(abs(low - prior_low) <= prior_low * 0.02::DOUBLE, false) AS equal_low,
coalesce(high > prior_high AND close < prior_high, false) AS swept_high, coalesce(low < prior_low AND close > prior_low, false) AS swept_low FROM y""",
    ),
    "structure_shifts": (
        lambda s, d: structure.shifts(hourly(s, d)).select("symbol", "bucket", "shift"),
        f"""WITH {B} SELECT symbol, bucket, CASE WHEN count(*) OVER {before(299)} >= 10 AND close > max(high) OVER {before(299)} THEN 'up' WHEN count(*) OVER {before(299)} >= 10 AND close < min(low) OVER {before(299)} THEN 'down' ELSE 'none' END AS shift FROM b""",
    ),
    "fair_value_gaps": (
        lambda s, d: structure.fair_value_gaps(hourly(s, d)),
        f"""WITH {B}, x AS (SELECT symbol, bucket, lag(high) OVER {ORDER} AS ph, lag(low) OVER {ORDER} AS pl, lead(high) OVER {ORDER} AS nh, lead(low) OVER {ORDER} AS nl,
min(low) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS ll, max(high) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS hh FROM b),
g AS (SELECT symbol, bucket, CASE WHEN nl > ph THEN 'up' ELSE 'down' END AS side, CASE WHEN nl > ph THEN ph ELSE nh END AS bottom, CASE WHEN nl > ph THEN nl ELSE pl END AS top, CASE WHEN nl > ph THEN ll <= ph ELSE hh >= pl END AS filled FROM x WHERE nl > ph OR nh < pl),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY bucket DESC) AS INTEGER) AS nth FROM g WHERE NOT coalesce(filled, false))
SELECT symbol, bucket, side, bottom, top, nth FROM r WHERE nth <= 5""",
    ),
    "order_blocks": (
        lambda s, d: rounded(structure.order_blocks(hourly(s, d)), "volume_ratio"),
        f"""WITH {B}, x AS (SELECT *, lead(close) OVER {ORDER} AS c1, lead(open) OVER {ORDER} AS o1, lead(close, 2) OVER {ORDER} AS c2, lead(open, 2) OVER {ORDER} AS o2, lead(bucket, 2) OVER {ORDER} AS known_at, volume / nullif(avg(volume) OVER {back(20)}, 0) AS volume_ratio FROM b),
y AS (SELECT *, CASE WHEN close < open AND c1 > o1 AND c2 > o2 AND c2 > high THEN 'up' WHEN close > open AND c1 < o1 AND c2 < o2 AND c2 < low THEN 'down' END AS side FROM x),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY bucket DESC) AS INTEGER) AS nth FROM y WHERE side IS NOT NULL)
SELECT symbol, side, bucket, known_at, high, low, round(volume_ratio, 6) AS volume_ratio, nth FROM z WHERE nth <= 5""",
    ),
    "key_levels": (
        lambda s, d: structure.key_levels(hourly(s, d)),
        f"""WITH {B}, d AS (SELECT symbol, bucket // {DAY} AS day, max(high) AS high, min(low) AS low, first(open ORDER BY bucket) AS day_open, max(high) FILTER (bucket % {DAY} < {8 * HOUR}) AS asia_high, min(low) FILTER (bucket % {DAY} < {8 * HOUR}) AS asia_low FROM b GROUP BY 1, 2)
SELECT symbol, day, day_open, asia_high, asia_low, first_value(day_open) OVER (PARTITION BY symbol, day - (day + 3) % 7 ORDER BY day) AS week_open, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low,
CASE WHEN lag(day) OVER w = day - 1 THEN lag(high) OVER w END AS yesterday_high, CASE WHEN lag(day) OVER w = day - 1 THEN lag(low) OVER w END AS yesterday_low,
max(high) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS week_high, min(low) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS week_low
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)""",
    ),
    "regimes": (
        regimes,
        f"""WITH {N}, a AS (SELECT *, avg(tr) OVER {back(14)} AS atr FROM n),
x AS (SELECT symbol, bucket, CASE WHEN n > 1 THEN regr_slope(close, n) OVER {back(20)} END / nullif(atr, 0) AS slow, CASE WHEN n > 1 THEN regr_slope(close, n) OVER {back(5)} END / nullif(atr, 0) AS fast, (max(high) OVER {back(20)} - min(low) OVER {back(20)}) / nullif(atr, 0) AS spread FROM a)
SELECT symbol, bucket, round(slow, 6) AS slow, round(fast, 6) AS fast, round(spread, 6) AS spread, CASE WHEN slow > 0.12 AND fast > -0.35 THEN 'trend_up' WHEN slow < -0.12 AND fast < 0.35 THEN 'trend_down' WHEN spread > 8 THEN 'expansion' ELSE 'chop' END AS regime FROM x""",
    ),
    "profile_value_area": (
        lambda s, d: profile.top_volume_area(day_levels(s, d)),
        f"""WITH {PROFILE}, r AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY symbol, day ORDER BY qty DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, sum(qty) OVER (PARTITION BY symbol, day) AS total FROM p)
SELECT symbol, day, first(level ORDER BY qty DESC, level) AS poc, max(level) FILTER (pre < total * 0.7) AS value_high, min(level) FILTER (pre < total * 0.7) AS value_low, CAST(sum(qty) AS BIGINT) AS qty FROM r GROUP BY 1, 2""",
    ),
    "profile_contiguous_area": (lambda s, d: profile.contiguous_area(day_levels(s, d)), None),
    "profile_nodes": (
        lambda s, d: profile.nodes(day_levels(s, d)).select("symbol", "day", "level", "qty", "node"),
        f"""WITH {PROFILE}, m AS (SELECT *, avg(qty) OVER (PARTITION BY symbol, day) AS mean FROM p) SELECT symbol, day, level, qty, CASE WHEN qty > 2 * mean THEN 'high' ELSE 'low' END AS node FROM m WHERE qty > 2 * mean OR qty < 0.3::DOUBLE * mean""",
    ),
    "single_prints": (
        prints,
        f"""WITH {T}, h AS (SELECT symbol, ts_ms // {30 * MINUTE} AS period, ts_ms // {DAY} AS day, (min(CAST(round(price * 100000000) AS BIGINT)) // {WIDE} * {WIDE}) AS lo, (max(CAST(round(price * 100000000) AS BIGINT)) // {WIDE} * {WIDE}) AS hi FROM t GROUP BY 1, 2, 3),
v AS (SELECT symbol, day, period, unnest(range(lo, hi + 1, {WIDE})) AS level FROM h), o AS (SELECT symbol, day, level, min(period) AS period FROM v GROUP BY 1, 2, 3 HAVING min(period) = max(period)),
i AS (SELECT *, level // {WIDE} - row_number() OVER (PARTITION BY symbol, day, period ORDER BY level) AS island FROM o)
SELECT symbol, day, period, min(level) AS low_level, max(level) AS high_level, count(*) AS levels FROM i GROUP BY symbol, day, period, island""",
    ),
}
