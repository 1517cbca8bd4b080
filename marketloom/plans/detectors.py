"""SQL of the routed detectors, written apart from their expressions: context, candidates, gates, score and choice."""

from __future__ import annotations

from ..functions.clocks import DAY
from .base import STEP, N

CONTEXT_SQL = f"""{N}, c0 AS (SELECT *, bucket // {DAY} AS day, (high + low + close) / 3 AS tp, sum(delta) OVER (PARTITION BY symbol ORDER BY n) AS total, sum(delta) OVER (PARTITION BY symbol, bucket // {DAY} ORDER BY n) AS cvd FROM n),
c1 AS (SELECT *, close > lag(close) OVER w AS up, cvd > lag(cvd) OVER w AS flows, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 3 THEN regr_slope(total, n) OVER (w ROWS 19 PRECEDING) END AS cvd_slope,
  avg(CASE WHEN n > 1 THEN tr END) OVER (w ROWS 13 PRECEDING) AS atr, avg(tr) OVER (w ROWS 13 PRECEDING) AS mean_tr, regr_slope(close, n) OVER (w ROWS 19 PRECEDING) AS b20, regr_slope(close, n) OVER (w ROWS 4 PRECEDING) AS b5,
  max(high) OVER (w ROWS 19 PRECEDING) - min(low) OVER (w ROWS 19 PRECEDING) AS span, max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h20, min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l20,
  max(high) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS h50, min(low) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS l50, volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS vr, coalesce(delta / nullif(volume, 0), 0) AS taker
  FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY n)),
c2 AS (SELECT *, CASE WHEN up AND NOT flows THEN 1 WHEN NOT up AND flows THEN -1 ELSE 0 END AS sgn, coalesce(sum(tp * volume) OVER d / nullif(sum(volume) OVER d, 0), close) AS vwap, sum(tp * tp * volume) OVER d / nullif(sum(volume) OVER d, 0) AS sq,
  CASE WHEN b20 / mean_tr > 0.12 AND b5 / mean_tr > -0.35 THEN 'trend_up' WHEN b20 / mean_tr < -0.12 AND b5 / mean_tr < 0.35 THEN 'trend_down' WHEN span / mean_tr > 8 THEN 'expansion' ELSE 'chop' END AS regime, bucket // 60000 % 1440 AS minute
  FROM c1 WINDOW d AS (PARTITION BY symbol, day ORDER BY n)),
c3 AS (SELECT *, sqrt(greatest(0, coalesce(sq - vwap * vwap, 0))) AS sigma, n - max(CASE WHEN fresh THEN n END) OVER (PARTITION BY symbol ORDER BY n) + 1 AS len FROM (SELECT *, coalesce(sgn <> lag(sgn) OVER (PARTITION BY symbol ORDER BY n), true) AS fresh FROM c2)),
lv AS (SELECT symbol, ts_ms // {DAY} AS day, price_units - price_units % {STEP} AS level, CAST(sum(qty) AS BIGINT) AS q FROM t GROUP BY ALL),
lr AS (SELECT *, sum(q) OVER (PARTITION BY symbol, day ORDER BY q DESC, level) - q AS before, sum(q) OVER (PARTITION BY symbol, day) AS whole FROM lv),
va AS (SELECT symbol, day + 1 AS day, arg_max(level, (q, -level)) / 1e8 :: DOUBLE AS poc, max(level) FILTER (before < 0.7 * whole) / 1e8 :: DOUBLE AS vh, min(level) FILTER (before < 0.7 * whole) / 1e8 :: DOUBLE AS vl FROM lr GROUP BY 1, 2),
x AS (SELECT c3.*, sgn * len AS divergence, poc, vh, vl, coalesce(high > h50 AND close < h50, false) AS swept_high, coalesce(low < l50 AND close > l50, false) AS swept_low, minute < 1260 AND minute >= 480 AS opening FROM c3 LEFT JOIN va USING (symbol, day))"""


def pattern(rank: int, name: str, side: str, when: str, stop: str, target: str) -> str:
    return f"SELECT *, {rank} AS rank, '{name}' AS detector, '{side}' AS side, close AS entry, {stop} AS stop, {target} AS target FROM x WHERE {when}"


PATTERNS = [
    ("range_reversal", "long", "swept_low AND delta < 0", "low - 0.25 * atr", "close + 2 * (close - low + 0.25 * atr)"),
    ("range_reversal", "short", "swept_high AND delta > 0", "high + 0.25 * atr", "close - 2 * (high + 0.25 * atr - close)"),
    ("value_failed_auction", "short", "close < vh AND prev_close > vh AND delta < 0", "greatest(vh + 0.25 * atr, high)", "poc"),
    ("value_failed_auction", "long", "close > vl AND prev_close < vl AND delta > 0", "least(vl - 0.25 * atr, low)", "poc"),
    ("session_breakout", "long", "opening AND close > h20 AND coalesce(cvd_slope, 0) > 0 AND taker > 0", "close - 0.5 * atr", "close + atr"),
    ("session_breakout", "short", "opening AND close < l20 AND coalesce(cvd_slope, 0) < 0 AND taker < 0", "close + 0.5 * atr", "close - atr"),
    ("vwap_pullback", "long", "regime = 'trend_up' AND low <= vwap AND close > vwap AND delta > 0", "least(low, vwap) - 0.5 * atr", "vwap + 2 * sigma"),
    ("vwap_pullback", "short", "regime = 'trend_down' AND high >= vwap AND close < vwap AND delta < 0", "greatest(high, vwap) + 0.5 * atr", "vwap - 2 * sigma"),
    ("divergence_reversal", "short", "divergence >= 2 AND regime <> 'trend_up'", "close + atr", "close - 2 * atr"),
    ("divergence_reversal", "long", "divergence <= -2 AND regime <> 'trend_down'", "close - atr", "close + 2 * atr"),
    ("range_breakout", "long", "vr >= 1.5 AND close > h20 AND delta > 0", "greatest((h20 + l20) / 2, close - 2 * atr)", "close + 3 * atr"),
    ("range_breakout", "short", "vr >= 1.5 AND close < l20 AND delta < 0", "least((h20 + l20) / 2, close + 2 * atr)", "close - 3 * atr"),
]
ROUTED_SQL = f"""WITH {CONTEXT_SQL}, k AS ({" UNION ALL ".join(pattern(i, *p) for i, p in enumerate(PATTERNS))}),
g AS (SELECT *, abs(target - entry) / nullif(abs(entry - stop), 0) AS reward, CASE side WHEN 'long' THEN 1 ELSE -1 END AS s FROM k),
v AS (SELECT *, round(0.4 :: DOUBLE * least(1, reward / 3) + 0.3 :: DOUBLE * greatest(0, least(1, s * taker)) + 0.15 :: DOUBLE * least(1, coalesce(vr, 1) / 3) + 0.15 :: DOUBLE * CASE WHEN (regime = 'trend_up' AND s > 0) OR (regime = 'trend_down' AND s < 0) THEN 1 ELSE 0 END, 9) AS score
  FROM g WHERE s * (entry - stop) > 0 AND s * (target - entry) > 0 AND reward >= 1)
SELECT symbol, bucket, detector, side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY symbol, bucket ORDER BY score DESC, rank) = 1"""
