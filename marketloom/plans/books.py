"""Registered queries: books in archives, replayed into bars, and asked by orders when the price comes to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, HOUR
from ..operators import bars as bar_op
from ..operators import depth, search
from ..sources import archives
from ..sources import trades as src
from .base import STEP, T, rounded
from .files import folder, messages


def archived(s, d):
    """The event table as messages in archives of a day, a member a symbol."""
    t, at = src.trades(s, d), folder(s)
    lines = messages(t)
    m = F.from_json("value", "ts long, data struct<s:string,u:long>")
    lines = lines.select(m["data"]["s"].alias("symbol"), m["ts"].alias("ts_ms"), m["data"]["u"].alias("seq"), "value")
    archives.write_book_archives(lines, at).count()
    return at


START = 1_704_067_200_000


def scanned(s, d):
    m = archives.read_book_archives(s, archived(s, d), START + 3 * DAY, START + 20 * DAY + HOUR)
    return m.select("member", "symbol", "ts_ms", "seq", "type", F.size("b").alias("n_bids"), F.get("b", F.lit(0))["price"].alias("bid"), F.get("a", F.lit(0))["qty"].alias("ask_qty"))


def bars(s, d):
    samples = depth.book_samples(archives.read_book_archives(s, archived(s, d), columns=["symbol", "ts_ms", "seq", "type", "b", "a"]))
    out = depth.book_minutes(samples, HOUR)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


def entries(s, d):
    price, qty = F.round("price", 2) / 2 + 560, (100 + 3 * F.col("qty")).cast("double")
    orders = src.trades(s, d).where("seq % 5 = 0").select(F.col("seq").alias("id"), "symbol", "ts_ms", price.alias("entry"), (~F.col("is_sell")).alias("is_long"), qty.alias("risk"))
    return rounded(search.order_books(src.read_book_json(s, _lines(s, d)), orders), "liq_ratio", "wall_dist", "book_imbalance")


def _lines(s, d):
    at = folder(s)
    messages(src.trades(s, d)).write.text(at)
    return at


def seconds(s, d):
    """Features of the book at the end of each second, as a table: what follows reads it several times, and the replay runs once."""
    at = folder(s)
    depth.book_seconds(depth.book_features(depth.book_samples(src.read_book_json(s, _lines(s, d)), slot_ms=1000))).write.parquet(at)
    return s.read.parquet(at)


#: Books by SQL: at each message the last quantity of every price that its day has set so far.
STATE = f"""{T}, x AS (SELECT *, ts_ms // {DAY} AS day, row_number() OVER (PARTITION BY symbol, ts_ms // {DAY} ORDER BY ts_ms, seq) = 1 AS f FROM t),
u AS (SELECT symbol, day, ts_ms, seq, 'b' AS side, round(price, 2) AS p, (qty % 4 + f :: INT) :: DOUBLE AS q FROM x WHERE is_sell OR f
  UNION ALL SELECT symbol, day, ts_ms, seq, 'a', round(price, 2) + 1000, (qty % 4 + f :: INT) :: DOUBLE FROM x WHERE NOT is_sell OR f),
st AS (SELECT x.symbol, x.day, x.ts_ms, x.seq, side, u.p, arg_max(u.q, (u.ts_ms, u.seq)) AS q FROM x JOIN u ON u.symbol = x.symbol AND u.day = x.day AND (u.ts_ms, u.seq) <= (x.ts_ms, x.seq) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_ms, seq, side ORDER BY CASE side WHEN 'b' THEN -p ELSE p END) AS k FROM st WHERE q > 0),
fe AS (SELECT symbol, day, ts_ms, seq, max(p) FILTER (side = 'b') AS bid, min(p) FILTER (side = 'a') AS ask, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'a') AS na,
  {", ".join(f"sum(q) FILTER (side = '{x}' AND k <= {n}) AS {x}{n}" for x in "ba" for n in (5, 10, 20))}, max(q) FILTER (side = 'b' AND k <= 5) AS mb, max(q) FILTER (side = 'a' AND k <= 5) AS ma
  FROM rk GROUP BY ALL HAVING bid < ask),
smp AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 10000 AS spread, {", ".join(f"(b{n} - a{n}) / (b{n} + a{n}) AS o{n}" for n in (5, 10, 20))}, nb >= 5 AND na >= 5 AS deep FROM fe)"""
MEANS = {"near_bid5": "b5", "near_ask5": "a5", "max_bid5": "mb", "max_ask5": "ma"}

QUERIES = {
    "source_book_archive": (
        scanned,
        f"""WITH {T}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_ms // {DAY} ORDER BY ts_ms, seq) = 1 AS f FROM t)
SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') || '_' || symbol || '.data' AS member, symbol, ts_ms, seq, CASE WHEN f THEN 'snapshot' ELSE 'delta' END AS type, CAST(is_sell OR f AS INTEGER) AS n_bids,
  CASE WHEN is_sell OR f THEN round(price, 2) END AS bid, CASE WHEN NOT is_sell OR f THEN (qty % 4 + CAST(f AS INTEGER)) :: DOUBLE END AS ask_qty FROM x WHERE ts_ms >= {START + 3 * DAY} AND ts_ms < {START + 20 * DAY + HOUR}""",
    ),
    "book_archive_bars": (
        bars,
        f"""WITH {STATE} SELECT symbol, ts_ms - ts_ms % {HOUR} AS bucket, {", ".join(f"round(avg(o{n}), 6) AS obi{n}_mean" for n in (5, 10, 20))}, round(min(o10), 6) AS obi10_min, round(max(o10), 6) AS obi10_max, round(avg(spread), 6) AS spread_mean,
  round(first(mid ORDER BY ts_ms, seq), 6) AS mid_open, round(last(mid ORDER BY ts_ms, seq), 6) AS mid_close, count(*) AS n_samples, {", ".join(f"round(avg(CASE WHEN deep THEN {v} ELSE 0 END), 6) AS {k}" for k, v in MEANS.items())} FROM smp GROUP BY 1, 2""",
    ),
    "heatmap_cells": (
        lambda s, d: bar_op.heatmap_cells(src.trades(s, d), HOUR, STEP),
        f"""WITH {T} SELECT symbol, ts_ms - ts_ms % {HOUR} AS bucket, is_sell, price_units // {STEP} * {STEP} + CASE WHEN is_sell OR price_units % {STEP} = 0 THEN 0 ELSE {STEP} END AS level, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS trades FROM t GROUP BY ALL""",
    ),
    "book_entries": (
        entries,
        f"""WITH {STATE}, o AS (SELECT seq AS id, symbol, day, ts_ms, round(price, 2) / 2 + 560 AS entry, NOT is_sell AS is_long, (100 + 3 * qty) :: DOUBLE AS risk FROM x WHERE seq % 5 = 0),
h AS (SELECT o.*, smp.ts_ms AS hit_ms, smp.seq AS hit_seq FROM o JOIN smp ON smp.symbol = o.symbol AND smp.day = o.day AND smp.ts_ms >= o.ts_ms AND CASE WHEN is_long THEN mid <= entry ELSE mid >= entry END
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY smp.ts_ms, smp.seq) = 1),
l AS (SELECT h.id, h.symbol, hit_ms, entry, is_long, risk, sum(q) FILTER (side = 'a') AS up, sum(q) FILTER (side = 'b') AS dn, arg_max(p, (q, -p)) FILTER (side = CASE WHEN is_long THEN 'a' ELSE 'b' END) AS wall, max(q) FILTER (side = CASE WHEN is_long THEN 'a' ELSE 'b' END) AS wall_qty
  FROM h JOIN rk ON rk.symbol = h.symbol AND rk.ts_ms = h.hit_ms AND rk.seq = h.hit_seq AND CASE side WHEN 'a' THEN p BETWEEN entry AND entry + 3 * risk ELSE p BETWEEN entry - 3 * risk AND entry END GROUP BY ALL HAVING up > 0 AND dn > 0),
r AS (SELECT *, CASE WHEN is_long THEN up ELSE dn END AS ahead, CASE WHEN is_long THEN dn ELSE up END AS behind FROM l)
SELECT id, symbol, hit_ms, round(ahead / (behind + CAST(1e-9 AS DOUBLE)), 6) AS liq_ratio, round(abs(wall - entry) / risk, 6) AS wall_dist, wall_qty, round((ahead - behind) / (ahead + behind), 6) AS book_imbalance FROM r""",
    ),
}
#: For ``source_book_replay``: the last sample of each second, by day.
REPLAY_SQL = f"""WITH {STATE}, sec AS (SELECT * FROM smp QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms // 1000 ORDER BY ts_ms DESC, seq DESC) = 1)
SELECT symbol, ts_ms - ts_ms % {DAY} AS bucket, count(*) AS n_samples, round(first(mid ORDER BY ts_ms), 6) AS mid_open, round(last(mid ORDER BY ts_ms), 6) AS mid_close, round(avg(o10), 6) AS obi10_mean FROM sec GROUP BY 1, 2"""
