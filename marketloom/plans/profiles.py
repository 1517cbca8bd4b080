"""Registered queries: rolling, weekly and monthly profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import bias_factor
from ..operators import rolling_profile as op
from ..functions.clocks import DAY
from .base import STEP, N, T, hourly, numbered_bars, rounded

WINDOW, BINS, PERIOD_BINS = 60, 20, 12


def moving(s, d):
    out = op.rolling_profile(numbered_bars(s, d), WINDOW, BINS, chunk=100).where("poc IS NOT NULL")
    return rounded(out.select("symbol", "bucket", "poc", "value_high", "value_low", "thin_below"), "poc", "value_high", "value_low", "thin_below")


def periods(s, d):
    b = op.period_profile(hourly(s, d), op.WEEK, "week", PERIOD_BINS)
    b = op.closed_periods(op.period_profile(b, op.MONTH, "month", PERIOD_BINS), op.WEEK, "week")
    long, short = (bias_factor(F.col("week_location"), F.col("month_location"), F.lit(x)) for x in (True, False))
    cols = [f"{p}_{c}" for p in ("week", "month", "prior_week") for c in ("poc", "value_high", "value_low")]
    return rounded(b.select("symbol", "bucket", *cols, "week_location", "month_location", long.alias("long_factor"), short.alias("short_factor")), *cols)


def area_sql(counts: str, at: str, bins: int | str, ties_up: bool) -> str:
    """Ends of the value area as a fold over the bins: the counts are a list, ``at`` counts from 1."""
    above, below = f"coalesce(CASE WHEN a.hi < {bins} THEN {counts}[a.hi + 1] END, -1)", f"coalesce(CASE WHEN a.lo > 1 THEN {counts}[a.lo - 1] END, -1)"
    up = f"{above} {'>=' if ties_up else '>'} {below}"
    done = f"a.held >= list_sum({counts}) * 0.7 :: DOUBLE OR (a.lo = 1 AND a.hi = {bins})"
    start = f"{{lo: {at}, hi: {at}, held: {counts}[{at}]}}"
    move = f"CASE WHEN {done} THEN a WHEN {up} THEN {{lo: a.lo, hi: a.hi + 1, held: a.held + {above}}} ELSE {{lo: a.lo - 1, hi: a.hi, held: a.held + {below}}} END"
    return f"list_reduce(list_prepend({start}, [{start} FOR i IN range({bins})]), lambda a, b: {move})"


MOVING_SQL = f"""WITH {N}, e AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM n WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
p AS (SELECT a.symbol, a.n, a.bucket, a.close AS px, a.lo, a.hi, b.volume, len(list_filter(range({BINS}), lambda k: a.lo + k * ((a.hi - a.lo) / {BINS}) <= b.close)) AS bin
  FROM e a JOIN n b ON b.symbol = a.symbol AND b.n BETWEEN a.n - {WINDOW} AND a.n - 1 WHERE a.n > {WINDOW} AND a.hi - a.lo >= 1e-6),
h AS (SELECT symbol, n, bucket, px, lo, hi, CAST(sum(volume) AS BIGINT) AS v, bin FROM p GROUP BY ALL),
l AS (SELECT symbol, bucket, px, lo, (hi - lo) / {BINS} AS step, list_transform(range(1, {BINS + 1}), lambda k: CAST(coalesce(map_from_entries(list({{k: bin, v: v}}))[k], 0) AS BIGINT)) AS c FROM h GROUP BY symbol, n, bucket, px, lo, hi),
m AS (SELECT *, list_position(c, list_max(c)) AS at_, len(list_filter(range(1, {BINS + 1}), lambda k: lo + k * step <= px)) AS under FROM l),
a AS (SELECT *, {area_sql("c", "at_", BINS, True)} AS area, CASE WHEN under > 0 THEN list_position(c[1:under], list_min(c[1:under])) END AS thin FROM m)
SELECT symbol, bucket, round(lo + (at_ - 0.5) * step, 6) AS poc, round(lo + (area.hi - 0.5) * step, 6) AS value_high, round(lo + (area.lo - 0.5) * step, 6) AS value_low, round(lo + (thin - 0.5) * step, 6) AS thin_below FROM a"""


def period_sql(name: str, ms: int) -> str:
    return f"""{name}0 AS (SELECT symbol, bucket, high, low, close, volume, bucket // {ms} AS period, max(high) OVER w AS top, min(low) OVER w AS bottom FROM n WINDOW w AS (PARTITION BY symbol, bucket // {ms} ORDER BY bucket)),
{name}1 AS (SELECT symbol, period, min(bucket) AS since, arg_min(bottom, bucket) AS base, arg_min(top - bottom, bucket) / {PERIOD_BINS} AS step FROM {name}0 WHERE top > bottom GROUP BY 1, 2),
{name}2 AS (SELECT symbol, bucket, period, k, base, step, close, CAST(round_even(volume * greatest(least(high, base + k * step + step * 0.5 :: DOUBLE + step * 0.5 :: DOUBLE) - greatest(low, base + k * step + step * 0.5 :: DOUBLE - step * 0.5 :: DOUBLE), 0) / greatest(high - low, step * 0.1 :: DOUBLE) * 1000000, 0) AS BIGINT) AS v
  FROM {name}0 JOIN {name}1 USING (symbol, period), range({PERIOD_BINS}) r(k) WHERE bucket >= since),
{name}3 AS (SELECT symbol, bucket, period, base, step, close, list(total ORDER BY k) AS c FROM (SELECT *, CAST(sum(v) OVER (PARTITION BY symbol, period, k ORDER BY bucket) AS BIGINT) AS total FROM {name}2) GROUP BY ALL HAVING sum(total) > 0),
{name}4 AS (SELECT *, {PERIOD_BINS + 1} - list_position(list_reverse(c), list_max(c)) AS at_ FROM {name}3),
{name}5 AS (SELECT *, {area_sql("c", "at_", PERIOD_BINS, False)} AS area FROM {name}4),
{name} AS (SELECT symbol, bucket, period, close, base + (at_ - 0.5) * step AS poc, base + (area.hi - 0.5) * step AS vh, base + (area.lo - 0.5) * step AS vl, CASE WHEN close > base + (area.hi - 0.5) * step THEN 'above_value' WHEN close < base + (area.lo - 0.5) * step THEN 'below_value' ELSE 'in_value' END AS loc FROM {name}5)"""


def factor_sql(with_: str, against: str) -> str:
    a, b = (" + ".join(f"coalesce(CAST({t}.loc = '{x}' AS INT), 0)" for t in ("week", "month")) for x in (with_, against))
    return f"CAST(CASE WHEN {a} > 0 AND {b} = 0 THEN 1.08 WHEN {a} > 0 THEN 1.03 WHEN {b} > 0 THEN 0.90 ELSE 1.0 END AS DOUBLE)"


PERIODS_SQL = f"""WITH {N}, {period_sql("week", op.WEEK)}, {period_sql("month", op.MONTH)},
last_ AS (SELECT symbol, period, {{poc: poc, vh: vh, vl: vl}} AS e FROM week QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY bucket DESC) = 1),
ends AS (SELECT symbol, period, lag(e) OVER (PARTITION BY symbol ORDER BY period) AS p FROM (SELECT DISTINCT symbol, bucket // {op.WEEK} AS period FROM n) LEFT JOIN last_ USING (symbol, period))
SELECT n.symbol, n.bucket, round(week.poc, 6) AS week_poc, round(week.vh, 6) AS week_value_high, round(week.vl, 6) AS week_value_low, round(month.poc, 6) AS month_poc, round(month.vh, 6) AS month_value_high, round(month.vl, 6) AS month_value_low,
  round(p.poc, 6) AS prior_week_poc, round(p.vh, 6) AS prior_week_value_high, round(p.vl, 6) AS prior_week_value_low, week.loc AS week_location, month.loc AS month_location,
  {factor_sql("above_value", "below_value")} AS long_factor, {factor_sql("below_value", "above_value")} AS short_factor
FROM n LEFT JOIN week USING (symbol, bucket) LEFT JOIN month USING (symbol, bucket) LEFT JOIN ends ON ends.symbol = n.symbol AND ends.period = n.bucket // {op.WEEK}"""

#: For ``profile_contiguous_area``: levels that traded in a day, in order.
CONTIGUOUS_SQL = f"""WITH {T}, lv AS (SELECT symbol, ts_ms // {DAY} AS day, price_units - price_units % {STEP} AS level, CAST(sum(qty) AS BIGINT) AS v FROM t GROUP BY ALL),
l AS (SELECT symbol, day, list(level ORDER BY level) AS levels, list(v ORDER BY level) AS c FROM lv GROUP BY 1, 2), m AS (SELECT *, list_position(c, list_max(c)) AS at_ FROM l),
a AS (SELECT *, {area_sql("c", "at_", "len(c)", True)} AS area FROM m)
SELECT symbol, day, levels[at_] AS poc, levels[area.lo] AS value_low, levels[area.hi] AS value_high, area.held AS inside FROM a"""

QUERIES = {"profile_rolling": (moving, MOVING_SQL), "profile_periods": (periods, PERIODS_SQL)}
