"""Registered queries: exhausted buyers, and events of the microstructure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY
from ..operators import exhaustion, microevents
from ..operators.indicators import rows
from ..sources import trades as src
from .base import N, numbered_bars, rounded
from .books import STATE, seconds

#: As in the plan of phases: the event table's prices as cents on a dollar level.
LEVEL = 60_000
X = exhaustion.Rules(windows=(5, 9), narrow=0.02, wide=0.9, turn_bars=3, turn_ratio=0.2, volume=0.6, volume_bars=15, close_in=0.7, body=0.05, wick=0.7, rest=12, sessions=("overlap", "new_york", "london", "asia"))
E = microevents.Rules(base=25, least=6, burst=3, extreme=8, rest=4, after=(2, 4, 8))


def tired_buyers(s, d):
    b = numbered_bars(s, d).withColumns({c: F.col(c) + LEVEL for c in ("open", "high", "low", "close")})
    b = b.withColumns({"absorbed_ask": (F.col("delta") > 0) & (F.col("close") < F.col("open")), "obi10": F.try_divide("delta", "volume"), "thin_below": F.col("volume") < F.avg("volume").over(rows(-6, -1)), "spread_bps": F.col("n_trades").cast("double")})
    out = exhaustion.buyer_exhaustion(b, X)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


def found(s, d):
    return microevents.micro_events(microevents.second_panel(seconds(s, d), src.trades(s, d)), E)


def events(s, d):
    return rounded(found(s, d), "after_1", "after_2", "after_3", "best", "worst")


def one_a_moment(s, d):
    return rounded(microevents.resolved(found(s, d), 600_000), "after_1", "after_2", "after_3", "best", "worst")


def range_sql(n: int) -> str:
    k = min(X.turn_bars, n)
    return f"max(h) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS hi{n}, min(l) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS lo{n}, CAST(sum(delta) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS BIGINT) AS f{n}, CAST(sum(delta) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS BIGINT) AS t{n}"


def broken_sql(rank: int, n: int) -> str:
    return f"""SELECT *, {rank} AS rank, {n} AS range_bars, hi{n} AS hi, lo{n} AS lo, f{n} AS flow, t{n} AS turn, abs(t{n}) / f{n} AS ratio, greatest(hi{n}, h) AS stop FROM g WHERE f{n} > 0 AND t{n} < 0 AND (hi{n} - lo{n}) / c * 100 BETWEEN {X.narrow} AND {X.wide} AND abs(t{n}) / f{n} >= {X.turn_ratio} AND c < lo{n} AND (lo{n} - c) / (hi{n} - lo{n}) <= {X.extension}"""


REGION = "CASE WHEN m >= 780 AND m < 960 THEN 'overlap' WHEN m >= 780 AND m < 1260 THEN 'new_york' WHEN m >= 480 AND m < 960 THEN 'london' WHEN m < 480 THEN 'asia' ELSE 'off_hours' END"
TIRED_SQL = f"""WITH RECURSIVE {N}, p AS (SELECT symbol, bucket, n, volume, delta, n_trades, open + {LEVEL} AS o, high + {LEVEL} AS h, low + {LEVEL} AS l, close + {LEVEL} AS c, bucket // 60000 % 1440 AS m FROM n),
g0 AS (SELECT *, {REGION} AS region, volume / avg(volume) OVER (w ROWS {X.volume_bars + 4} PRECEDING) AS vr, volume < avg(volume) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS thin, {", ".join(range_sql(n) for n in X.windows)} FROM p WINDOW w AS (PARTITION BY symbol ORDER BY n)),
g AS (SELECT * FROM g0 WHERE n >= {X.volume_bars + max(X.windows)} AND vr >= {X.volume} AND delta < 0 AND region <> 'off_hours' AND n_trades <= 5
  AND (h - l <= 1e-10 OR ((c - l) / (h - l) <= {X.close_in} AND greatest(o - c, 0) / (h - l) >= {X.body} AND (h - greatest(o, c)) / (h - l) <= {X.wick}))),
k AS ({" UNION ALL ".join(broken_sql(i, n) for i, n in enumerate(X.windows))}),
z AS (SELECT * FROM k WHERE stop - c > 1e-10 AND l > c - 2 * (stop - c) AND (c - (c - 2 * (stop - c))) / (stop - c) >= {X.reward} QUALIFY row_number() OVER (PARTITION BY symbol, n ORDER BY rank) = 1),
r AS (SELECT symbol, min(n) AS n FROM z GROUP BY symbol UNION ALL SELECT r.symbol, (SELECT min(z.n) FROM z WHERE z.symbol = r.symbol AND z.n >= r.n + {X.rest}) AS n FROM r WHERE r.n IS NOT NULL)
SELECT z.symbol, z.bucket, z.n, round(c, 6) AS entry, range_bars, round(hi, 6) AS range_high, round(lo, 6) AS range_low, round((hi - lo) / c * 100, 6) AS range_pct, flow AS range_cvd, turn AS turn_cvd, round(ratio, 6) AS turn_ratio, round(stop, 6) AS stop,
  round(c - 2 * (stop - c), 6) AS target, round(vr, 6) AS volume_ratio, delta AS break_delta, concat_ws(',', CASE WHEN delta > 0 AND c < o THEN 'absorbed_ask' END, CASE WHEN thin THEN 'thin_below' END, CASE WHEN delta / volume < -0.05 THEN 'obi10' END) AS signs,
  CAST(coalesce(CAST(thin AS INT), 0) + coalesce(CAST(delta / volume < -0.05 AS INT), 0) AS INTEGER) AS score FROM z JOIN r ON r.symbol = z.symbol AND r.n = z.n"""

WHEN_SQL = {
    "big_trade_buy": "big AND delta > 0", "big_trade_sell": "big AND delta < 0", "delta_burst_pos": "d >= 3 * ds", "delta_burst_neg": "d <= -3 * ds", "vol_spike": "spike", "absorb_ask": "heavy AND d > 0", "absorb_bid": "heavy AND d < 0",
    "sweep_up": "mid > top_ AND spike", "sweep_down": "mid < bottom AND spike", "obi_extreme_pos": "o10 >= 0.8", "obi_extreme_neg": "o10 <= -0.8", "obi_flip_up": "po < -0.5 AND o10 > 0.5", "obi_flip_down": "po > 0.5 AND o10 < -0.5",
    "spread_spike": "wide", "micro_div_up": "lean > 0.25", "micro_div_down": "lean < -0.25",
}
STAT = lambda c, f: f"CASE WHEN count(*) OVER (w ROWS {E.base - 1} PRECEDING) >= {E.least} THEN {f}({c}) OVER (w ROWS {E.base - 1} PRECEDING) END"
EVENTS_SQL = f"""WITH RECURSIVE {STATE}, tq AS (SELECT symbol, ts_ms, seq, max(q) FILTER (side = 'b' AND k = 1) AS bq, max(q) FILTER (side = 'a' AND k = 1) AS aq FROM rk GROUP BY ALL),
sec AS (SELECT smp.*, (bid * aq + ask * bq) / (bq + aq) AS micro, smp.ts_ms // 1000 AS second FROM smp JOIN tq USING (symbol, ts_ms, seq) QUALIFY row_number() OVER (PARTITION BY symbol, smp.ts_ms // 1000 ORDER BY smp.ts_ms DESC, seq DESC) = 1),
fl AS (SELECT symbol, ts_ms // 1000 AS second, CAST(sum(qty) AS BIGINT) AS vol, CAST(sum(CASE WHEN is_sell THEN -qty ELSE qty END) AS BIGINT) AS delta, max(qty) AS mx FROM t GROUP BY 1, 2),
p0 AS (SELECT sec.symbol, sec.day, sec.ts_ms, sec.second, mid, micro, o10, spread, coalesce(vol, 0) AS vol, coalesce(delta, 0) AS delta, coalesce(mx, 0) AS mx FROM sec LEFT JOIN fl USING (symbol, second)),
p1 AS (SELECT *, row_number() OVER w AS n, sum(delta) OVER (w ROWS {E.burst - 1} PRECEDING) AS d, sum(vol) OVER (w ROWS {E.burst - 1} PRECEDING) AS v, {STAT("vol", "avg")} AS vm, {STAT("vol", "stddev_samp")} + 1e-9 :: DOUBLE AS vs, mx >= {STAT("mx", "avg")} + 3 * ({STAT("mx", "stddev_samp")} + 1e-9 :: DOUBLE) AS big,
  {STAT("delta", "stddev_samp")} * sqrt({E.burst}) + 1e-9 :: DOUBLE AS ds, (mid - lag(mid, {E.burst}) OVER w) / mid AS mv, spread >= {STAT("spread", "avg")} + 5 * ({STAT("spread", "stddev_samp")} + 1e-9 :: DOUBLE) AS wide, max(mid) OVER (w ROWS BETWEEN {E.extreme} PRECEDING AND 1 PRECEDING) AS top_,
  min(mid) OVER (w ROWS BETWEEN {E.extreme} PRECEDING AND 1 PRECEDING) AS bottom, lag(o10, {E.burst}) OVER w AS po, (micro - mid) * 10000 / (spread * mid + 1e-9 :: DOUBLE) AS lean, {", ".join(f"(lead(mid, {h}) OVER w / mid - 1) * 10000 AS f{k}" for k, h in enumerate(E.after))},
  (max(mid) OVER (w ROWS BETWEEN CURRENT ROW AND {E.after[2] - 1} FOLLOWING) / mid - 1) * 10000 AS best, (min(mid) OVER (w ROWS BETWEEN CURRENT ROW AND {E.after[2] - 1} FOLLOWING) / mid - 1) * 10000 AS worst
  FROM p0 WINDOW w AS (PARTITION BY symbol, day ORDER BY second)),
p2 AS (SELECT *, v >= {E.burst} * (vm + 3 * vs) AS spike, v >= {E.burst} * (vm + vs) AND abs(mv) < 0.0002 AS heavy FROM p1 WHERE f2 IS NOT NULL),
ev AS ({" UNION ALL ".join(f"SELECT symbol, day, n, ts_ms, '{k}' AS event, {microevents.KINDS[k]} AS hint, f0, f1, f2, best, worst FROM p2 WHERE {w}" for k, w in WHEN_SQL.items())}),
ch AS (SELECT symbol, day, event, min(n) AS n FROM ev GROUP BY ALL UNION ALL SELECT symbol, day, event, (SELECT min(e.n) FROM ev e WHERE e.symbol = ch.symbol AND e.day = ch.day AND e.event = ch.event AND e.n >= ch.n + {E.rest}) AS n FROM ch WHERE n IS NOT NULL),
kept AS (SELECT symbol, ts_ms, event, hint, round(f0, 6) AS after_1, round(f1, 6) AS after_2, round(f2, 6) AS after_3, round(best, 6) AS best, round(worst, 6) AS worst, day FROM ev JOIN ch USING (symbol, day, event, n))"""
RANK = "list_position([" + ", ".join(f"'{k}'" for k in microevents.PRIORITY) + "], event)"

QUERIES = {
    "buyer_exhaustion": (tired_buyers, TIRED_SQL),
    "micro_events": (events, f"{EVENTS_SQL} SELECT * EXCLUDE (day) FROM kept"),
    "micro_events_resolved": (
        one_a_moment,
        f"""{EVENTS_SQL}, il AS (SELECT *, sum(g) OVER (PARTITION BY symbol, day ORDER BY ts_ms, event) AS island FROM (SELECT *, CAST(coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY symbol, day ORDER BY ts_ms, event) > 600000, true) AS INT) AS g FROM kept))
SELECT * EXCLUDE (day, g, island), count(*) OVER (PARTITION BY symbol, day, island) AS of_island FROM il QUALIFY row_number() OVER (PARTITION BY symbol, day, island ORDER BY {RANK}, ts_ms) = 1""",
    ),
}
