"""Registered queries: looks at unfinished bars, and freshness of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, HOUR
from ..operators import intrabar as op
from ..operators.indicators import rows
from ..sources.trades import trades
from .base import N, numbered_bars

#: The table has a trade every twenty minutes a symbol: bars are of four hours, and clocks in hours.
R = op.Rules(apart_ms=HOUR // 6, most=4, move=0.4, fallback_ms=HOUR, rest_ms=5 * HOUR)


def looks(s, d):
    closes = numbered_bars(s, d).withColumn("atr", F.avg("tr").over(rows(-13))).where(F.col("bucket") / HOUR % 4 == 3).select("symbol", (F.col("bucket") + HOUR).alias("ts_ms"), F.col("close").alias("price"), "atr")
    t = trades(s, d).select("symbol", "ts_ms", "seq", "price", (F.col("qty") >= 80).alias("fires"))
    out = op.intrabar_looks(closes, t, R)
    return out.withColumn("moved", F.round("moved", 6))


SOURCES = ["buy", "sell", "large"]


def fresh(s, d):
    t = trades(s, d)
    bars = numbered_bars(s, d).select("symbol", (F.col("bucket") + HOUR).alias("ts_ms"))
    side = t.select("symbol", F.when(F.col("is_sell"), "sell").otherwise("buy").alias("source"), "ts_ms")
    large = t.where("qty >= 85").select("symbol", F.lit("large").alias("source"), "ts_ms")
    return op.freshness(bars, side.unionByName(large), SOURCES, 2 * HOUR, {"large": 2})


def age_sql(name: str, test: str) -> str:
    return f"(SELECT max(t.ts_ms) FROM t WHERE t.symbol = x.symbol AND t.ts_ms // {DAY} = x.ts_ms // {DAY} AND t.ts_ms <= x.ts_ms AND {test}) AS {name}"


def text_sql(name: str) -> str:
    s = f"(age_{name} // 1000)"
    return f"CASE WHEN age_{name} IS NULL THEN 'never' WHEN {s} < 60 THEN {s} || 's' ELSE ({s} // 60) || 'm' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || 's' END AS text_{name}"


#: A row a trade or close, each from the one before of its symbol and day.
LOOKS_SQL = f"""WITH RECURSIVE {N}, atr AS (SELECT symbol, bucket, close, avg(tr) OVER (PARTITION BY symbol ORDER BY bucket ROWS 13 PRECEDING) AS atr FROM n),
rows_ AS (SELECT symbol, bucket + {HOUR} AS ts, 0 AS kind, 0 AS seq, close AS price, atr, false AS fires FROM atr WHERE (bucket // {HOUR}) % 4 = 3 UNION ALL SELECT symbol, ts_ms, 1, seq, price, NULL, qty >= 80 FROM t),
x AS (SELECT *, ts // {DAY} AS day, row_number() OVER (PARTITION BY symbol, ts // {DAY} ORDER BY ts, kind, seq) AS k FROM rows_),
r AS (SELECT symbol, day, 0 :: BIGINT AS k, 0 :: BIGINT AS ts, NULL :: DOUBLE AS atr, 0 :: DOUBLE AS price, 0 :: BIGINT AS looked, 0 AS cnt, false AS fired, 0 :: BIGINT AS sig, false AS look, 0 :: DOUBLE AS moved, false AS far, 0 :: DOUBLE AS px, false AS fires FROM (SELECT DISTINCT symbol, day FROM x)
  UNION ALL SELECT symbol, day, k, ts, CASE WHEN kind = 0 THEN xatr ELSE atr END, CASE WHEN kind = 0 OR look THEN xp ELSE price END, CASE WHEN kind = 0 OR look THEN ts ELSE looked END, CASE WHEN kind = 0 THEN 0 WHEN look THEN cnt + 1 ELSE cnt END,
    CASE WHEN kind = 0 THEN false WHEN look AND xf THEN true ELSE fired END, CASE WHEN look AND xf THEN ts ELSE sig END, look, mv, far, xp, xf
  FROM (SELECT *, kind = 1 AND atr IS NOT NULL AND NOT fired AND greatest(0, ts - sig) >= {R.rest_ms} AND cnt < {R.most} AND xp > 0 AND greatest(0, ts - looked) >= {R.apart_ms} AND (far OR greatest(0, ts - looked) >= {R.fallback_ms}) AS look
    FROM (SELECT x.symbol, x.day, x.k, x.ts, x.kind, x.atr AS xatr, x.price AS xp, x.fires AS xf, r.atr, r.price, r.looked, r.cnt, r.fired, r.sig, abs(x.price - r.price) AS mv, coalesce(r.atr > 0 AND abs(x.price - r.price) >= {R.move} * r.atr, false) AS far
      FROM r JOIN x ON x.symbol = r.symbol AND x.day = r.day AND x.k = r.k + 1)))
SELECT symbol, ts AS ts_ms, px AS price, CAST(cnt AS INTEGER) AS nth, round(moved, 6) AS moved, CASE WHEN far THEN 'move' ELSE 'time' END AS why, fires AS signal FROM r WHERE look"""

QUERIES = {
    "intrabar_looks": (looks, LOOKS_SQL),
    "input_freshness": (
        fresh,
        f"""WITH {N}, x AS (SELECT symbol, bucket + {HOUR} AS ts_ms FROM n), y AS (SELECT *, {age_sql("b", "NOT is_sell")}, {age_sql("s", "is_sell")}, {age_sql("l", "qty >= 85")} FROM x),
z AS (SELECT symbol, ts_ms, ts_ms - b AS age_buy, ts_ms - s AS age_sell, ts_ms - l AS age_large FROM y)
SELECT *, {", ".join(text_sql(x) for x in SOURCES)}, CAST(coalesce(CAST(age_buy < {2 * HOUR} AS INT), 0) + coalesce(CAST(age_sell < {2 * HOUR} AS INT), 0) + 2 * coalesce(CAST(age_large < {2 * HOUR} AS INT), 0) AS INTEGER) AS ok, 4 AS total FROM z""",
    ),
}
