"""Registered queries: bar patterns of research studies, and near misses of a detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, research, scan
from ..operators.indicators import rows
from .base import N, numbered_bars, rounded
from .detectors import CONTEXT_SQL
from .reports import context

DAY = 86_400_000


def patterns(s, d):
    b = scan.sample_ema(numbered_bars(s, d), "symbol", ["bucket"], "close", 2 / 21, "ema", 5 * DAY)
    b = b.withColumns({"atr": F.avg("tr").over(rows(-13)), "vr": F.try_divide("volume", F.avg("volume").over(rows(-49)))})
    b = research.block_above(research.gaps_above(research.big_trades(b), 30, 0.05), drop=0.4)
    b = b.withColumns({"stacked": research.stacked(), "regime": research.study_regime(), "atr_median": research.upper_median("atr", 60), "displaced": research.displaced()})
    return rounded(b.select("symbol", "bucket", "big_sell", "big_buy", "gap_above", "gap_near", "block_near", "stacked", "regime", "atr_median", "displaced"), "atr_median")


def misses(s, d):
    c = context(s, d)
    named = {"opening": F.col("region").isin("london", "overlap", "new_york"), "above": F.col("close") > F.col("prev_high20"), "slope": F.col("cvd_slope") > 0, "flow": F.col("taker") > 0}
    return detectors.near_misses(c, named).select("symbol", "bucket", F.concat_ws(",", "failed").alias("failed"))


PATTERNS_SQL = f"""WITH RECURSIVE {N}, e AS (SELECT symbol, n, close AS ema FROM n WHERE n = 1 UNION ALL SELECT n.symbol, n.n, e.ema * (1 - 2 :: DOUBLE / 21) + n.close * (2 :: DOUBLE / 21) FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1),
a AS (SELECT n.*, ema, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, volume / nullif(avg(volume) OVER (w ROWS 49 PRECEDING), 0) AS vr, avg(volume) OVER (w ROWS 19 PRECEDING) AS vm, lag(low, 2) OVER w AS top, lag(open, 3) OVER w AS o3, lag(high, 3) OVER w AS h3, lag(close, 3) OVER w AS c3,
  sign(delta) AS s0, lag(sign(delta)) OVER w AS s1, lag(sign(delta), 2) OVER w AS s2, n.n > 1 AND close > ema * 1.002 AS u0, n.n > 1 AND close < ema * 0.998 AS d0 FROM n JOIN e USING (symbol, n) WINDOW w AS (PARTITION BY n.symbol ORDER BY n.n)),
b2 AS (SELECT *, lag(atr, 3) OVER w AS a3, avg(atr) OVER (w ROWS 19 PRECEDING) AS am, u0 AND lag(u0) OVER w AND lag(u0, 2) OVER w AS up, d0 AND lag(d0) OVER w AND lag(d0, 2) OVER w AS down, list_sort(list(atr) OVER (w ROWS 59 PRECEDING)) AS held FROM a WINDOW w AS (PARTITION BY symbol ORDER BY n)),
g AS (SELECT i.symbol, i.n, i.high AS bottom, min(k.n) AS entered FROM b2 i LEFT JOIN b2 k ON k.symbol = i.symbol AND k.n BETWEEN i.n AND i.n + 30 AND k.close BETWEEN i.high AND i.top WHERE i.top > i.high GROUP BY ALL),
ga AS (SELECT j.symbol, j.n, max((g.bottom - j.close) / (j.close + 1e-9 :: DOUBLE) < 0.05) AS near FROM b2 j JOIN g ON g.symbol = j.symbol AND g.n BETWEEN j.n - 30 AND j.n AND (entered IS NULL OR entered > j.n) AND g.bottom > j.close GROUP BY ALL),
bl AS (SELECT symbol, n AS since, h3 AS bh, o3 AS bl, lead(n) OVER (PARTITION BY symbol ORDER BY n) AS until FROM b2 WHERE c3 > o3 AND c3 - close > 0.4 * a3 AND close < o3),
bn AS (SELECT j.symbol, j.n, j.close BETWEEN bl AND bh AND NOT EXISTS (SELECT 1 FROM b2 k WHERE k.symbol = j.symbol AND k.n BETWEEN since AND j.n AND k.close < bl * 0.999) AS near FROM b2 j JOIN bl ON bl.symbol = j.symbol AND j.n >= since AND (until IS NULL OR j.n < until))
SELECT b2.symbol, bucket, coalesce(b2.n >= 5 AND sell_qty > 2.5 * vm AND (high - greatest(open, close)) / (high - low + 1e-9 :: DOUBLE) > 0.30, false) AS big_sell, coalesce(b2.n >= 5 AND buy_qty > 2.5 * vm AND (least(open, close) - low) / (high - low + 1e-9 :: DOUBLE) > 0.30, false) AS big_buy,
  ga.n IS NOT NULL AS gap_above, coalesce(ga.near, false) AS gap_near, coalesce(bn.near, false) AS block_near, CASE WHEN s0 = 1 AND s1 = 1 AND s2 = 1 THEN 'bullish' WHEN s0 = -1 AND s1 = -1 AND s2 = -1 THEN 'bearish' ELSE 'none' END AS stacked,
  CASE WHEN down THEN 'trend_down' WHEN up THEN 'trend_up' WHEN b2.n >= 5 AND atr / (am + 1e-9 :: DOUBLE) > 1.30 THEN 'expansion' ELSE 'chop' END AS regime, round(held[len(held) // 2 + 1], 6) AS atr_median, coalesce(close < open AND abs(close - open) / (high - low + 1e-9 :: DOUBLE) > 0.65 AND vr > 1.5, false) AS displaced
FROM b2 LEFT JOIN ga ON ga.symbol = b2.symbol AND ga.n = b2.n LEFT JOIN bn ON bn.symbol = b2.symbol AND bn.n = b2.n"""

QUERIES = {
    "research_patterns": (patterns, PATTERNS_SQL),
    "near_misses": (
        misses,
        f"""WITH {CONTEXT_SQL}, m AS (SELECT symbol, bucket, opening, coalesce(close > h20, false) AS above, coalesce(cvd_slope > 0, false) AS slope, taker > 0 AS flow FROM x)
SELECT symbol, bucket, CASE WHEN NOT opening THEN 'opening' WHEN NOT above THEN 'above' WHEN NOT slope THEN 'slope' ELSE 'flow' END AS failed FROM m WHERE opening::INT + above::INT + slope::INT + flow::INT = 3""",
    ),
}
