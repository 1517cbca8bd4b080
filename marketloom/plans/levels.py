"""Registered queries: limit levels and what they are drawn from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, HOUR
from ..operators import levels as op
from ..operators.indicators import rows
from .base import N, numbered_bars, rounded

#: The event table's prices on a level at which the tolerances, shares of the price, are of the size of an hour's moves.
LEVEL = 2_000
R = op.Rules(least=40, area=24, swing=20, block=8, gap_bars=20, level_bars=6, range_pct=0.3, cap=4.0, expansion=1.2, rounds=(50.0, 80.0))


def shifted(s, d):
    b = numbered_bars(s, d).withColumns({c: F.col(c) + LEVEL for c in ("high", "low", "close")})
    return b.withColumns({"poc": (F.col("high") + F.col("low")) / 2, "atr": F.avg("tr").over(rows(-13)), "atr_median": F.avg("tr").over(rows(-99)), "atr_mean": F.avg("tr").over(rows(-39))})


def limit_levels(s, d):
    return rounded(op.limit_levels(shifted(s, d), R), "price", "stop", "near", "far")


def inverse_gaps(s, d):
    b = op.inverse_gaps(shifted(s, d), R.gap_bars)
    each = lambda side, c: b.select("symbol", "bucket", F.lit(side).alias("side"), F.explode(c).alias("g"))
    return rounded(each("up", "filled_up").unionByName(each("down", "filled_down")).select("symbol", "bucket", "side", "g.*"), "bottom", "top")


def trend_test(s, d):
    return shifted(s, d).select("symbol", "bucket", op.trending(F.col("atr"), F.col("atr_mean"), R.expansion).alias("trend"))


FRAME = 4 * HOUR


def frame_stops(s, d):
    return rounded(op.frame_stop(shifted(s, d), FRAME, 0.5).select("symbol", "bucket", "frame_atr", "stop", "stop_pct"), "frame_atr", "stop", "stop_pct")


BARS = f"""{N}, lb AS (SELECT symbol, bucket, n, volume, bucket // {DAY} AS day, high + {LEVEL} AS h, low + {LEVEL} AS l, close + {LEVEL} AS c, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, avg(tr) OVER (w ROWS 99 PRECEDING) AS atr_median, avg(tr) OVER (w ROWS 39 PRECEDING) AS atr_mean
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY n))"""
GAPS = f"""gp AS (SELECT a.symbol, a.n AS at_, 'up' AS side, z.h AS bottom, a.l AS top FROM lb a JOIN lb z ON z.symbol = a.symbol AND z.n = a.n - 2 WHERE a.l > z.h
  UNION ALL SELECT a.symbol, a.n, 'down', a.h, z.l FROM lb a JOIN lb z ON z.symbol = a.symbol AND z.n = a.n - 2 WHERE a.h < z.l),
gt AS (SELECT gp.symbol, at_, side, bottom, top, min(k.n) AS turned FROM gp JOIN lb k ON k.symbol = gp.symbol AND k.n BETWEEN at_ + 1 AND at_ + {R.gap_bars} AND CASE side WHEN 'up' THEN k.c < bottom ELSE k.c > top END GROUP BY ALL)"""
TREND = """em AS (SELECT *, list_reduce([{now: x, old: NULL :: DOUBLE} FOR x IN cs], lambda s, x: {now: x.now * (2 :: DOUBLE / 6) + s.now * (1 - 2 :: DOUBLE / 6), old: s.now}) AS e FROM (SELECT symbol, n, lag(c) OVER (PARTITION BY symbol ORDER BY n) AS pc, list(c) OVER (PARTITION BY symbol ORDER BY n ROWS 59 PRECEDING) AS cs FROM lb b))"""
TREND_OF = f"(n >= 25 AND (coalesce(atr_mean > 0 AND atr / atr_mean > {R.expansion}, false) OR coalesce((c > e.now * 1.002 AND pc > e.old * 1.002) OR (c < e.now * 0.998 AND pc < e.old * 0.998), false)))"
AIM = {1: "list_filter([vh, sh, dh, wh], lambda x: x IS NOT NULL AND x > ({p}) * 1.001)", -1: "list_filter([vl, sl, dl, wl], lambda x: x IS NOT NULL AND x < ({p}) * 0.999)"}


def kind_sql(rank: int, kind: str, s: int, price: str, stop: str, when: str, enough: bool = False, source: str = "m") -> str:
    near, far = ("list_min", "list_max") if s > 0 else ("list_max", "list_min")
    more = f" AND {s} * (far - price) / ({s} * (price - stop)) >= {R.reward}" if enough else ""
    return f"""SELECT symbol, bucket, c, trend, wide, {rank} AS rank, '{kind}' AS kind, {s} AS s, price, stop, CASE WHEN abs({near}(aim) - far) >= 1 THEN {near}(aim) END AS near, far
FROM (SELECT *, {far}(aim) AS far FROM (SELECT *, {price} AS price, {stop} AS stop, {AIM[s].format(p=price)} AS aim FROM {source} WHERE {when})) WHERE len(aim) > 0{more}"""


def rounds_sql() -> str:
    out = []
    for k, step in enumerate(R.rounds):
        at = f"(round(c / {step}) * {step} :: DOUBLE)"
        virgin = f"len(list_filter(bl, lambda x: abs(x - {at}) / {at} <= {R.touch})) = 0 AND len(list_filter(bh, lambda x: abs(x - {at}) / {at} <= {R.touch})) = 0"
        out.append(kind_sql(8 + 2 * k, "round_l", 1, at, f"{at} - {R.level_stop} * atr", f"{virgin} AND c > {at} AND l <= {at} * {1 + R.touch}", True))
        out.append(kind_sql(9 + 2 * k, "round_h", -1, at, f"{at} + {R.level_stop} * atr", f"{virgin} AND c < {at} AND h >= {at} * {1 - R.touch}", True))
    return "\nUNION ALL ".join(out)


def gap_sql(rank: int, kind: str, s: int) -> str:
    """The oldest turned gap that the bar tests, then the filters of the bar's own."""
    side, edge, other = ("up", "bottom", "top") if s < 0 else ("down", "top", "bottom")
    back = f"h >= bottom * (1 - {R.gap_touch} :: DOUBLE) AND c < bottom" if s < 0 else f"l <= top * (1 + {R.gap_touch} :: DOUBLE) AND c > top"
    aim = AIM[s].format(p=edge)
    first = f"(SELECT m.*, at_, bottom, top FROM m JOIN gt ON gt.symbol = m.symbol AND side = '{side}' AND at_ BETWEEN m.n - {R.gap_bars - 1} AND m.n - 2 AND turned < m.n AND top - bottom >= {R.gap_least} * atr AND {back} AND len({aim}) > 0 QUALIFY row_number() OVER (PARTITION BY m.symbol, m.n ORDER BY at_) = 1)"
    return kind_sql(rank, kind, s, edge, f"{other} - {s} * 0.25 * atr", f"{s} * (c - hc) > 0 AND abs(c - {edge}) >= {R.away} * atr", source=first)


LEVELS_SQL = f"""WITH {BARS}, {GAPS}, {TREND},
vv AS (SELECT a.symbol, a.n, CAST(round(z.c / {R.step}) AS BIGINT) AS bin, CAST(sum(z.volume) AS BIGINT) AS v FROM lb a JOIN lb z ON z.symbol = a.symbol AND z.n BETWEEN a.n - {R.area - 1} AND a.n GROUP BY ALL),
vr AS (SELECT *, sum(v) OVER w - v AS before, sum(v) OVER (PARTITION BY symbol, n) AS total FROM vv WINDOW w AS (PARTITION BY symbol, n ORDER BY v DESC, bin)),
va AS (SELECT symbol, n, arg_max(bin, (v, bin)) * {R.step} AS vp, max(bin) FILTER (before < 0.7 * total) * {R.step} AS vh, min(bin) FILTER (before < 0.7 * total) * {R.step} AS vl FROM vr GROUP BY 1, 2),
dd AS (SELECT symbol, day, max(h) AS h, min(l) AS l FROM lb b GROUP BY 1, 2),
ds AS (SELECT a.symbol, a.day, max(z.h) AS wh, min(z.l) AS wl, max(z.h) FILTER (z.day = a.day - 1) AS dh, min(z.l) FILTER (z.day = a.day - 1) AS dl FROM dd a LEFT JOIN dd z ON z.symbol = a.symbol AND z.day BETWEEN a.day - 8 AND a.day - 1 GROUP BY 1, 2),
m0 AS (SELECT b.*, vp, vh :: DOUBLE AS vh, vl :: DOUBLE AS vl, wh, wl, dh, dl, pc, e, max(h) OVER (w ROWS BETWEEN {R.swing} PRECEDING AND 1 PRECEDING) AS sh, min(l) OVER (w ROWS BETWEEN {R.swing} PRECEDING AND 1 PRECEDING) AS sl, coalesce(lag(c, {R.hour}) OVER w, c) AS hc,
  list(l) OVER (w ROWS {R.block - 1} PRECEDING) AS rl, list(h) OVER (w ROWS {R.block - 1} PRECEDING) AS rh, arg_max({{h: h, l: l}}, (h - l, b.n)) OVER (w ROWS {R.block - 1} PRECEDING) AS ob, list(l) OVER (w ROWS BETWEEN {R.level_bars} PRECEDING AND 1 PRECEDING) AS bl, list(h) OVER (w ROWS BETWEEN {R.level_bars} PRECEDING AND 1 PRECEDING) AS bh
  FROM lb b JOIN va ON va.symbol = b.symbol AND va.n = b.n JOIN ds ON ds.symbol = b.symbol AND ds.day = b.day JOIN em ON em.symbol = b.symbol AND em.n = b.n WINDOW w AS (PARTITION BY b.symbol ORDER BY b.n)),
m AS (SELECT *, {TREND_OF} AS trend, coalesce(atr_median > 0 AND atr > atr_median, false) AS wide, (ob.h + ob.l) / 2 AS op FROM m0 WHERE n >= {R.least} AND atr > 0),
k AS ({kind_sql(0, "poc_ob", 1, "op", f"ob.l - {0.25 * R.stop_scale} * atr", f"c > hc AND abs(c - op) >= {R.away} * atr")}
UNION ALL {kind_sql(1, "poc_ob", -1, "op", f"ob.h + {0.25 * R.stop_scale} * atr", f"c < hc AND abs(c - op) >= {R.away} * atr")}
UNION ALL {kind_sql(2, "poc_def", 1, "vp", f"vp - {0.6 * R.stop_scale} * atr", f"c > hc AND abs(c - vp) >= {R.away} * atr AND len(list_filter(rl, lambda x: abs(x - vp) / vp <= {R.touch})) >= 2")}
UNION ALL {kind_sql(3, "poc_def_short", -1, "vp", f"vp + {0.6 * R.stop_scale} * atr", f"c < hc AND abs(c - vp) >= {R.away} * atr AND len(list_filter(rh, lambda x: abs(x - vp) / vp <= {R.touch})) >= 2")}
UNION ALL {gap_sql(4, "ifvg_bear", -1)}
UNION ALL {gap_sql(5, "ifvg_bull", 1)}
UNION ALL {kind_sql(6, "weekly_l", 1, f"wl * {1 + R.entry_touch}", f"wl * {1 + R.entry_touch} - {R.level_stop} * atr", f"wl > 0 AND l <= wl * {1 + R.entry_touch} AND c > wl", True)}
UNION ALL {kind_sql(7, "weekly_h", -1, f"wh * {1 - R.entry_touch}", f"wh * {1 - R.entry_touch} + {R.level_stop} * atr", f"wh > 0 AND h >= wh * {1 - R.entry_touch} AND c < wh", True)}
UNION ALL {rounds_sql()}),
f0 AS (SELECT * REPLACE (CASE WHEN abs(price - stop) < price * {R.stop_floor} THEN price - s * price * {R.stop_floor} ELSE stop END AS stop) FROM k),
f1 AS (SELECT *, abs(price - stop) AS risk, price + s * {R.cap} * abs(price - stop) AS top FROM f0),
f2 AS (SELECT * REPLACE (CASE WHEN s * (far - top) > 0 THEN top ELSE far END AS far, CASE WHEN s * (far - top) <= 0 OR (s * (near - price) > 0 AND s * (top - near) > 0) THEN near END AS near) FROM f1 WHERE risk > 0),
f3 AS (SELECT * FROM f2 WHERE abs(far - price) / risk >= {R.reward} AND s * (c - price) > 0 AND s * (price - stop) > 0 AND s * (far - price) > 0 AND NOT (NOT trend AND near IS NOT NULL AND abs(near - price) / price * 100 < {R.range_pct})
  QUALIFY row_number() OVER (PARTITION BY symbol, bucket, s, round(price / 2) ORDER BY rank) = 1)
SELECT symbol, bucket, CAST(rank AS INTEGER) AS rank, kind, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, round(price, 6) AS price, round(stop, 6) AS stop, round(near, 6) AS near, round(far, 6) AS far, near IS NOT NULL AS take_partial,
  CASE WHEN trend THEN 'trail' ELSE 'fade' END AS manage, CASE WHEN trend THEN 'trend' ELSE 'chop' END AS regime, CASE WHEN wide THEN 'high' ELSE 'low' END AS volatility FROM f3"""

QUERIES = {
    "limit_levels": (limit_levels, LEVELS_SQL),
    "inverse_gaps": (
        inverse_gaps,
        f"WITH {BARS}, {GAPS} SELECT b.symbol, b.bucket, side, at_ AS at, round(bottom, 6) AS bottom, round(top, 6) AS top, turned FROM lb b JOIN gt ON gt.symbol = b.symbol AND at_ BETWEEN b.n - {R.gap_bars - 1} AND b.n - 2 AND turned < b.n",
    ),
    "trend_test": (trend_test, f"WITH {BARS}, {TREND} SELECT symbol, bucket, {TREND_OF} AS trend FROM lb b JOIN em USING (symbol, n)"),
    "frame_stops": (
        frame_stops,
        f"""WITH RECURSIVE {BARS}, fr AS (SELECT symbol, bucket // {FRAME} AS f, max(h) AS h, min(l) AS l, arg_max(c, n) AS c FROM lb GROUP BY 1, 2),
ft AS (SELECT symbol, f, row_number() OVER w AS k, coalesce(greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)), h - l) AS tr FROM fr WINDOW w AS (PARTITION BY symbol ORDER BY f)),
wa AS (SELECT symbol, f, k, tr AS atr FROM ft WHERE k = 1 UNION ALL SELECT ft.symbol, ft.f, ft.k, wa.atr * (13 :: DOUBLE / 14) + ft.tr / 14 FROM wa JOIN ft ON ft.symbol = wa.symbol AND ft.k = wa.k + 1),
kn AS (SELECT symbol, f, lag(atr) OVER (PARTITION BY symbol ORDER BY f) AS atr FROM wa),
st AS (SELECT b.symbol, bucket, c, kn.atr, max(h) OVER (PARTITION BY b.symbol, bucket // {FRAME} ORDER BY n) + 0.5 * kn.atr AS stop FROM lb b JOIN kn ON kn.symbol = b.symbol AND kn.f = bucket // {FRAME})
SELECT symbol, bucket, round(atr, 6) AS frame_atr, round(stop, 6) AS stop, round((stop - c) / c * 100, 6) AS stop_pct FROM st""",
    ),
}
