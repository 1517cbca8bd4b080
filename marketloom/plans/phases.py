"""Registered queries: the phase machine over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import HOUR
from ..operators import indicators, phases
from ..operators.indicators import rows
from ..sources.trades import trades
from .base import N, hourly, numbered_bars, rounded

#: The event table's prices as cents on a dollar level, whose hours span a tenth of a percent.
LEVEL = 60_000
RULES = phases.Rules(narrow=0.05, wide=0.6, least=8, most=30, break_volume=0.9, toxic=0.5, turn_volume=0.7, reward=0.8, cooldown=8, warmup=20, window=40)


def context(s, d):
    """Hourly bars with the machine's inputs: toxicity, session flow, distance from the session's mean price, extremes, large trades, absorption."""
    b = numbered_bars(s, d).withColumns({c: F.col(c) + LEVEL for c in ("open", "high", "low", "close")})
    large = F.when(F.col("qty") >= 90, F.when(F.col("is_sell"), -F.col("qty")).otherwise(F.col("qty"))).otherwise(0)
    hours = trades(s, d).groupBy("symbol", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR))).alias("bucket")).agg(F.sum(large).alias("big_cvd"))
    b = indicators.cvd(b.join(hours, ["symbol", "bucket"])).withColumnRenamed("cvd", "session_cvd")
    b = b.withColumns({"vpin": indicators.vpin_mean(20), "value_high": F.max("close").over(rows(-24, -1)), "value_low": F.min("close").over(rows(-24, -1)), "mean": F.avg("close").over(rows(-23)), "atr": indicators.atr_mean(14)})
    absorbed = F.col("volume") > F.avg("volume").over(rows(-10, -1))
    return b.withColumns(
        {
            "stretch": F.try_divide(F.col("close") - F.col("mean"), "atr"), "trend": F.when(F.col("close") > F.col("mean"), "Bull").otherwise("Bear"),
            "naked": F.array(F.max("high").over(rows(-40, -1)) + 20.0, F.min("low").over(rows(-40, -1)) - 20.0), "thin": F.array(F.lag("close", 5).over(indicators.by_time())),
            "absorbed_bid": F.coalesce(absorbed & (F.col("delta") < 0) & (F.col("close") > F.col("open")), F.lit(False)),
            "absorbed_ask": F.coalesce(absorbed & (F.col("delta") > 0) & (F.col("close") < F.col("open")), F.lit(False)),
        }
    )


def signals(s, d):
    out = phases.phase_signals(context(s, d), RULES)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return rounded(out, *doubles)


def bands(s, d):
    b = hourly(s, d).withColumns({c: F.col(c) + LEVEL for c in ("high", "low", "close")})
    return rounded(phases.in_band(b, RULES).select("symbol", "bucket", "band", "in_band"), "band")


R = RULES
#: One row a bar, each from the row before: the machine's state beside the bar's inputs.
SIGNALS_SQL = f"""WITH RECURSIVE {N},
h AS (SELECT symbol, ts_ms - ts_ms % {HOUR} AS bucket, CAST(sum(CASE WHEN qty >= 90 THEN CASE WHEN is_sell THEN -qty ELSE qty END ELSE 0 END) AS BIGINT) AS big FROM t GROUP BY 1, 2),
p AS (SELECT symbol, bucket, n, volume, delta, tr, open + {LEVEL} AS o, high + {LEVEL} AS h, low + {LEVEL} AS l, close + {LEVEL} AS c FROM n),
x AS (SELECT p.*, big, sum(delta) OVER (PARTITION BY p.symbol, bucket // 86400000 ORDER BY bucket) AS session,
  avg(abs(delta) / volume) OVER (w ROWS 19 PRECEDING) AS vpin, max(c) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS vh, min(c) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS vl,
  avg(c) OVER (w ROWS 23 PRECEDING) AS mean, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, volume / avg(volume) OVER (w ROWS {R.window - 1} PRECEDING) AS vr,
  coalesce((delta - avg(delta) OVER (w ROWS {R.window - 1} PRECEDING)) / nullif(stddev_pop(delta) OVER (w ROWS {R.window - 1} PRECEDING), 0), 0) AS z,
  volume > avg(volume) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS loud, max(h) OVER (w ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) + 20 AS up, min(l) OVER (w ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) - 20 AS dn,
  lag(c, 5) OVER w AS back, max(h) OVER (w ROWS {R.least - 1} PRECEDING) AS wh, min(l) OVER (w ROWS {R.least - 1} PRECEDING) AS wl, sum(delta) OVER (w ROWS {R.least - 1} PRECEDING) AS wd
  FROM p JOIN h USING (symbol, bucket) WINDOW w AS (PARTITION BY p.symbol ORDER BY bucket)),
y AS (SELECT *, (c - mean) / atr AS stretch, c > mean AS bull, coalesce(loud AND delta < 0 AND c > o, false) AS ab, coalesce(loud AND delta > 0 AND c < o, false) AS aa FROM x),
r AS (
  SELECT symbol, 0 :: BIGINT AS n, 'idle' AS stage, 0 :: DOUBLE AS hi, 0 :: DOUBLE AS lo, 0 :: DOUBLE AS cvd, 0 AS len, 0 AS absorbed, 0 AS sign, 0 :: DOUBLE AS ext, 0 :: DOUBLE AS bvr, 0 :: DOUBLE AS bdelta, 0 :: DOUBLE AS bz,
    0 :: DOUBLE AS bstretch, 0 :: DOUBLE AS bbig, false AS babs, 0 AS waited, 0 :: BIGINT AS last, false AS fired, 0 :: DOUBLE AS stop, 0 :: DOUBLE AS target, '' AS source, 0 :: DOUBLE AS fhi, 0 :: DOUBLE AS flo
  FROM (SELECT DISTINCT symbol FROM y)
  UNION ALL
  SELECT symbol, n, CASE WHEN rests THEN stage WHEN stage = 'idle' THEN CASE WHEN opens THEN 'range' ELSE 'idle' END
      WHEN stage = 'range' THEN CASE WHEN inside THEN CASE WHEN fits THEN 'range' ELSE 'idle' END WHEN breaks THEN 'break' ELSE 'idle' END
      WHEN late OR fires THEN 'idle' ELSE 'break' END,
    CASE WHEN NOT rests AND stage = 'idle' AND opens THEN wh WHEN NOT rests AND stage = 'range' AND inside AND fits THEN greatest(hi, h) ELSE hi END,
    CASE WHEN NOT rests AND stage = 'idle' AND opens THEN wl WHEN NOT rests AND stage = 'range' AND inside AND fits THEN least(lo, l) ELSE lo END,
    CASE WHEN NOT rests AND stage = 'idle' AND opens THEN wd WHEN NOT rests AND stage = 'range' AND inside AND fits THEN cvd + delta ELSE cvd END,
    CASE WHEN NOT rests AND stage = 'idle' AND opens THEN {R.least} WHEN NOT rests AND stage = 'range' AND inside AND fits THEN len + 1 ELSE len END,
    CASE WHEN NOT rests AND stage = 'idle' AND opens THEN 0 WHEN NOT rests AND stage = 'range' AND inside AND fits THEN absorbed + CAST(ab OR aa AS INT) ELSE absorbed END,
    CASE WHEN new THEN way ELSE sign END, CASE WHEN new THEN CASE WHEN way < 0 THEN h ELSE l END ELSE ext END, CASE WHEN new THEN vr ELSE bvr END, CASE WHEN new THEN delta ELSE bdelta END,
    CASE WHEN new THEN z ELSE bz END, CASE WHEN new THEN stretch ELSE bstretch END, CASE WHEN new THEN big ELSE bbig END, CASE WHEN new THEN CASE WHEN way < 0 THEN aa ELSE ab END ELSE babs END,
    CASE WHEN new THEN 0 WHEN NOT rests AND stage = 'break' AND NOT late THEN waited + 1 ELSE waited END, CASE WHEN fires THEN n ELSE last END, fires, st, aim.x, aim.s, hi, lo
  FROM (SELECT *, NOT rests AND stage = 'break' AND NOT late AND back_in AND risk >= {R.least_risk} AND abs(aim.x - c) / risk >= {R.reward} AS fires, NOT rests AND stage = 'range' AND NOT inside AND breaks AS new
    FROM (SELECT *, coalesce(list_sort(list_filter([{{d: abs(back - c), k: 0, x: back, s: 'thin'}}, {{d: abs(up - c), k: 1, x: up, s: 'naked'}}, {{d: abs(dn - c), k: 1, x: dn, s: 'naked'}}, {{d: abs(CASE WHEN sign > 0 THEN vh ELSE vl END - c), k: 4, x: CASE WHEN sign > 0 THEN vh ELSE vl END, s: 'value'}}],
        lambda q: q.x IS NOT NULL AND sign * q.x > sign * (c + sign * risk * 0.5)))[1], {{d: 0 :: DOUBLE, k: 9, x: c + sign * risk * 2.0, s: 'two_risks'}}) AS aim
      FROM (SELECT *, abs(st - c) AS risk FROM (SELECT y.*, r.* EXCLUDE (symbol, n, fired, stop, target, source, fhi, flo), y.n < {R.warmup} OR y.n - r.last < {R.cooldown} AS rests, (wh - wl) / c * 100 BETWEEN {R.narrow} AND {R.wide} AND y.n >= {R.least} AS opens,
        lo < c AND c < hi AS inside, (greatest(hi, h) - least(lo, l)) / c * 100 <= {R.wide} AND len + 1 <= {R.most} AS fits, CASE WHEN c > hi THEN -1 ELSE 1 END AS way,
        (hi - lo) / c * 100 BETWEEN {R.narrow} AND {R.wide} AND vr >= {R.break_volume} AND (vpin > {R.toxic} OR CASE WHEN c > hi THEN -1 ELSE 1 END * delta > 0) AS breaks,
        waited >= {R.wait} AS late, CASE WHEN sign < 0 THEN c < hi ELSE c > lo END AND vr >= {R.turn_volume} AS back_in, ext * (1 - sign * CAST({R.buffer} AS DOUBLE) / 100) AS st
        FROM r JOIN y ON y.symbol = r.symbol AND y.n = r.n + 1))))),
f AS (SELECT r.*, bucket, c, vr, z, session, bull, vh, vl, abs(target - c) / abs(stop - c) AS reward, CASE WHEN sign < 0 THEN vh ELSE vl END AS edge, CASE WHEN sign < 0 THEN fhi ELSE flo END AS bound, bucket // 60000 % 1440 AS minute
  FROM r JOIN y USING (symbol, n) WHERE fired),
g AS (SELECT *, CAST(least(10, least(absorbed, 2) + 2 * CAST(babs AS INT) + 2 * CAST(sign * bdelta > 0 AS INT) + CASE WHEN bvr >= 3 THEN 2 WHEN bvr >= 2 THEN 1 ELSE 0 END + coalesce(CAST(abs(bstretch) >= 1.5 AS INT), 0) + 1
    + CAST(sign * session * c > 500000 AS INT) + coalesce(CAST(abs(bound - edge) / edge < 0.007 AS INT), 0) + CAST(sign * bbig * c > 100000 AS INT)) AS INTEGER) AS quality,
  greatest(0, -sign * (ext - bound) / bound * 100) AS extension, CASE WHEN minute BETWEEN 420 AND 539 THEN 'London' WHEN minute BETWEEN 810 AND 929 THEN 'NewYork' ELSE '' END AS zone FROM f),
k AS (SELECT *, least(1, quality / 10 * 0.30 + least(abs(bz), 3) / 3 * 0.20 + CASE WHEN zone <> '' THEN 0.15 ELSE 0 END + greatest(0, 6 - waited) / 5 * 0.15 + CASE WHEN bull = (sign > 0) THEN 0.20 ELSE 0 END) AS score FROM g)
SELECT symbol, bucket, CASE WHEN sign > 0 THEN 'long' ELSE 'short' END AS side, round(c, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, source, round(reward, 6) AS reward, round(fhi, 6) AS range_high, round(flo, 6) AS range_low,
  len AS range_bars, cvd AS range_cvd, round(ext, 6) AS extreme, round(bvr, 6) AS break_volume, bdelta AS break_delta, round(bz, 6) AS break_z, round(vr, 6) AS turn_volume, round(z, 6) AS turn_z, absorbed AS absorbed_bars, babs AS absorbed_break, quality,
  waited AS bars_to_turn, round(extension, 6) AS extension, zone, bull = (sign > 0) AS with_trend, round(score, 6) AS score, CAST(CASE WHEN score >= 0.7 THEN 2.0 WHEN score >= 0.5 THEN 1.5 WHEN score >= 0.3 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS sizing FROM k"""

QUERIES = {
    "phase_signals": (signals, SIGNALS_SQL),
    "phase_bands": (
        bands,
        f"""WITH {N}, x AS (SELECT symbol, bucket, (max(high) OVER w - min(low) OVER w) / (close + {LEVEL}) * 100 AS band, n FROM n WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS {R.least - 1} PRECEDING))
SELECT symbol, bucket, round(band, 6) AS band, n >= {R.least} AND band BETWEEN {R.narrow} AND {R.wide} AS in_band FROM x""",
    ),
}
