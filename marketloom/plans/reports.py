"""Registered queries: reports, mining, set operations, simulation and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, HOUR, region
from ..operators import depth, detectors, managers, mining, profile, recursive, reports, simulate, structure
from ..operators import indicators as ind
from ..operators import sets as op
from ..sources.trades import trades
from .base import STEP, WIDE, B, O, T, hourly, numbered_bars, outcomes, rounded

PERFORMANCE = """count(*) AS n, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, round(count(*) FILTER (r > 0) / count(*), 4) AS win_rate,
round(avg(r), 6) AS avg_r, round(sum(r), 6) AS sum_r, round(avg(r) FILTER (r > 0), 6) AS avg_win"""


def wilson(s, d):
    o = outcomes(s, d).groupBy("symbol", "is_sell").agg(F.count_if(F.col("r") > 0).alias("wins"), F.count(F.lit(1)).alias("n"))
    low, high = reports.wilson(F.col("wins"), F.col("n"))
    return rounded(o.select("symbol", "is_sell", "wins", "n", low.alias("low"), high.alias("high")), "low", "high")


def rules(s, d):
    named = {"big": F.col("qty") >= 60, "sell": F.col("is_sell"), "cheap": F.col("price") < 15, "asia": F.pmod("ts_ms", F.lit(DAY)) < 8 * HOUR}
    return mining.combinations(mining.conditions(outcomes(s, d), named), 30, 3)


def fills(s, d):
    t = trades(s, d).select("symbol", "is_sell", F.when(F.col("qty") % 3 == 0, "fill").otherwise("place").alias("event"))
    return reports.fill_ratio(t, "symbol", "is_sell")


def context(s, d):
    """One wide row a bar for the detectors."""
    b = numbered_bars(s, d)
    b = ind.cvd(b, daily=False).withColumn("cvd_slope", ind.slope("cvd", 20, 3)).drop("cvd")
    b = ind.cvd(b).withColumn("divergence_sign", ind.divergence_sign())
    b = ind.run_length(b, F.col("divergence_sign"), "divergence")
    b = structure.regime(structure.equal_extremes(ind.session_vwap(b), 50, 0.0003)).withColumn("atr", ind.atr_mean())
    b = b.withColumns(
        {
            "region": region(F.col("bucket")), "taker": F.coalesce(F.try_divide("delta", "volume"), F.lit(0.0)), "volume_ratio": ind.ratio_to_previous(20),
            "prev_high20": F.max("high").over(ind.rows(-20, -1)), "prev_low20": F.min("low").over(ind.rows(-20, -1)), "_day": F.floor(F.col("bucket") / DAY).cast("long"),
        }
    )
    areas = profile.top_volume_area(profile.day_profile(trades(s, d), STEP))
    price = lambda c: (F.col(c) / 1e8).alias(c)
    known = areas.select("symbol", (F.col("day") + 1).alias("_day"), price("poc"), price("value_high"), price("value_low"))
    return b.join(known, ["symbol", "_day"], "left").drop("_day")


def routed(s, d):
    return rounded(detectors.route(context(s, d)), "entry", "stop", "target", "score")


def simulated(s, d):
    signals = detectors.route(context(s, d)).select("symbol", "bucket", "side", "entry", "stop", "target")
    out = simulate.paper_account(hourly(s, d), signals, simulate.Rules(partial_at_r=1.5, cooldown_ms=2 * HOUR))
    return rounded(out, "entry", "exit", "size", "gross", "fees", "funding", "net", "r", "mfe_r", "mae_r", "balance", digits=4)


def trailed(s, d):
    signals = detectors.route(context(s, d)).select("symbol", "bucket", "side", "entry", "stop", "target")
    return rounded(managers.trailed_trades(hourly(s, d), signals), "entry", "exit", "r", digits=4)


def filled(s, d):
    t = trades(s, d).select("symbol", "ts_ms", "seq", "price")
    orders = t.selectExpr("symbol", "ts_ms", "seq as order_id", "price * 0.9 as price")
    return managers.limit_fills(orders, t, 2.0, DAY, 0.5)


def runs(s, d):
    u = trades(s, d).select("symbol", "ts_ms", "seq", (F.floor(F.col("price_units") / WIDE) * WIDE).cast("long").alias("level"), (F.col("qty") % 4).alias("qty"), (~F.col("is_sell")).alias("is_bid")).where("qty > 0")
    return depth.coalesce_runs(depth.depth_runs(u, 6 * HOUR), 0.5)


def books(s, d):
    """Books from the trades of each hour: sells rest as bids, buys as asks above them."""
    pair = F.struct((F.col("price") + F.when(F.col("is_sell"), 0.0).otherwise(1000.0)).alias("price"), F.col("qty").cast("double").alias("qty"))
    side = lambda sell: F.sort_array(F.collect_list(F.when(F.col("is_sell") == sell, pair)), asc=not sell)
    t = trades(s, d).groupBy("symbol", (F.col("ts_ms") - F.col("ts_ms") % (6 * HOUR)).alias("ts_ms")).agg(side(True).alias("bids"), side(False).alias("asks"))
    f = depth.book_features(t.where("size(bids) > 0 and size(asks) > 0"))
    return rounded(f.select("symbol", "ts_ms", "mid", "micro", "obi5", "obi10", "obi20", "bid_depth", "ask_depth", F.size("bid_walls").alias("n_walls"), "thin_above"), "mid", "micro", "obi5", "obi10", "obi20")


BOOK_SQL = f"""WITH {T}, g AS (SELECT symbol, ts_ms - ts_ms % {6 * HOUR} AS ts_ms,
list(price ORDER BY price DESC, qty DESC) FILTER (is_sell) AS bp, list(qty::DOUBLE ORDER BY price DESC, qty DESC) FILTER (is_sell) AS bq,
list(price + 1000 ORDER BY price, qty) FILTER (NOT is_sell) AS ap, list(qty::DOUBLE ORDER BY price, qty) FILTER (NOT is_sell) AS aq FROM t GROUP BY 1, 2),
x AS (SELECT *, [list_sum(bq[:k]) FOR k IN [5, 10, 20, 25]] AS b, [list_sum(aq[:k]) FOR k IN [5, 10, 20, 25]] AS a FROM g WHERE bp IS NOT NULL AND ap IS NOT NULL)
SELECT symbol, ts_ms, round((bp[1] + ap[1]) / 2, 6) AS mid, round((bp[1] * aq[1] + ap[1] * bq[1]) / nullif(bq[1] + aq[1], 0), 6) AS micro,
round(coalesce((b[1] - a[1]) / nullif(b[1] + a[1], 0), 0), 6) AS obi5, round(coalesce((b[2] - a[2]) / nullif(b[2] + a[2], 0), 0), 6) AS obi10, round(coalesce((b[3] - a[3]) / nullif(b[3] + a[3], 0), 0), 6) AS obi20,
b[4] AS bid_depth, a[4] AS ask_depth, CAST(len(list_filter(bq[:20], lambda v: v > 5 * b[3] / len(bq[:20]))) AS INTEGER) AS n_walls,
len(list_filter(aq[:10], lambda v: v < 0.3::DOUBLE * (a[2] / len(aq[:10])))) >= 3 AS thin_above FROM x"""

RULES_SQL = f"""WITH {O}, c AS (SELECT r, list_filter([CASE WHEN ts_ms % {DAY} < {8 * HOUR} THEN 'asia' END, CASE WHEN qty >= 60 THEN 'big' END, CASE WHEN price < 15 THEN 'cheap' END, CASE WHEN is_sell THEN 'sell' END], lambda v: v IS NOT NULL) AS h FROM o),
i AS (SELECT row_number() OVER () AS id, r, h FROM c), e AS (SELECT id, r, unnest(h) AS n FROM i),
k AS (SELECT n AS rule, r FROM e UNION ALL SELECT a.n || '+' || b.n, a.r FROM e a JOIN e b ON a.id = b.id AND a.n < b.n UNION ALL SELECT a.n || '+' || b.n || '+' || c.n, a.r FROM e a JOIN e b ON a.id = b.id AND a.n < b.n JOIN e c ON a.id = c.id AND b.n < c.n)
SELECT rule, count(*) AS n, round(count(*) FILTER (r > 0) / count(*), 4) AS win_rate, round(avg(r), 6) AS avg_r, round(sum(r), 6) AS sum_r FROM k GROUP BY 1 HAVING count(*) >= 30"""

QUERIES = {
    "report_performance": (lambda s, d: reports.performance(outcomes(s, d), "symbol", "is_sell"), f"WITH {O} SELECT symbol, is_sell, {PERFORMANCE} FROM o GROUP BY 1, 2"),
    "report_sessions": (
        lambda s, d: reports.performance(outcomes(s, d).withColumn("region", region(F.col("ts_ms"))), "region"),
        f"""WITH {O}, x AS (SELECT *, ts_ms % {DAY} // 60000 AS m FROM o) SELECT CASE WHEN m >= 780 AND m < 960 THEN 'overlap' WHEN m >= 780 AND m < 1260 THEN 'new_york' WHEN m >= 480 AND m < 960 THEN 'london' WHEN m < 480 THEN 'asia' ELSE 'off_hours' END AS region, {PERFORMANCE} FROM x GROUP BY 1""",
    ),
    "report_monthly": (lambda s, d: reports.monthly(outcomes(s, d), "symbol"), f"WITH {O} SELECT symbol, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS month, {PERFORMANCE} FROM o GROUP BY 1, 2"),
    "report_fill_ratio": (
        fills,
        f"""WITH {T}, e AS (SELECT symbol, is_sell, CASE WHEN qty % 3 = 0 THEN 'fill' ELSE 'place' END AS event FROM t)
SELECT symbol, is_sell, count(*) FILTER (event = 'place') AS placed, count(*) FILTER (event = 'fill') AS filled, round(count(*) FILTER (event = 'fill') / nullif(count(*) FILTER (event = 'place'), 0), 4) AS fill_ratio FROM e GROUP BY 1, 2""",
    ),
    "report_score_buckets": (
        lambda s, d: reports.score_buckets(outcomes(s, d)),
        f"WITH {O} SELECT CAST(floor(round(score / 0.05::DOUBLE, 6)) AS BIGINT) AS bucket, count(*) AS n, round(avg(r), 6) AS avg_r, round(count(*) FILTER (r > 0) / count(*), 4) AS win_rate FROM o GROUP BY 1",
    ),
    "report_decay": (
        lambda s, d: reports.decay(reports.score_buckets(outcomes(s, d))),
        f"""WITH {O}, g AS (SELECT CAST(floor(round(score / 0.05::DOUBLE, 6)) AS BIGINT) AS bucket, count(*) AS n, round(avg(r), 6) AS avg_r FROM o GROUP BY 1)
SELECT *, round(avg_r - lag(avg_r) OVER (ORDER BY bucket), 6) AS change, coalesce(avg_r > lag(avg_r) OVER (ORDER BY bucket), true) AS rises FROM g""",
    ),
    "report_quantiles": (
        lambda s, d: reports.quantiles(outcomes(s, d), "price", (0.1, 0.25, 0.5, 0.75, 0.9), "symbol"),
        f"WITH {O} SELECT symbol, count(price) AS n, round(quantile_cont(price, 0.1), 6) AS p10, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.75), 6) AS p75, round(quantile_cont(price, 0.9), 6) AS p90 FROM o GROUP BY 1",
    ),
    "report_wilson": (
        wilson,
        f"""WITH {O}, g AS (SELECT symbol, is_sell, count(*) FILTER (r > 0) AS wins, count(*) AS n FROM o GROUP BY 1, 2), x AS (SELECT *, wins / n AS p, 1.96::DOUBLE AS z FROM g)
SELECT symbol, is_sell, wins, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM x""",
    ),
    "report_rank_correlation": (
        lambda s, d: reports.rank_correlation(outcomes(s, d), "price", "qty", "symbol", "seq"),
        f"""WITH {O}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY price, seq)::DOUBLE AS x, row_number() OVER (PARTITION BY symbol ORDER BY qty, seq)::DOUBLE AS y FROM o)
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN corr(x, y) ELSE 0 END, 6) AS rho FROM k GROUP BY 1""",
    ),
    "report_threshold_sweep": (
        lambda s, d: rounded(reports.threshold_sweep(outcomes(s, d), "price", "symbol", 20), "cut"),
        f"""WITH {O}, c AS (SELECT symbol, unnest([10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90]) / 100 AS share, unnest(quantile_cont(price, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])) AS cut FROM o GROUP BY symbol),
m AS (SELECT c.symbol, share, cut, count(*) AS n, round(avg(r), 6) AS avg_r FROM o JOIN c ON o.symbol = c.symbol AND o.price >= c.cut GROUP BY 1, 2, 3 HAVING count(*) >= 20)
SELECT DISTINCT ON (symbol) symbol, share, round(cut, 6) AS cut, n, avg_r FROM m ORDER BY symbol, avg_r DESC, share""",
    ),
    "report_drawdown": (
        lambda s, d: reports.drawdown(outcomes(s, d), "symbol"),
        f"""WITH {O}, c AS (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY ts_ms, seq) AS total FROM o), f AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY symbol ORDER BY ts_ms, seq)) - total AS fall FROM c)
SELECT symbol, round(max(fall), 6) AS max_drawdown, round(last(total ORDER BY ts_ms, seq), 6) AS final_r FROM f GROUP BY 1""",
    ),
    "report_equity": (
        lambda s, d: reports.equity(outcomes(s, d), "symbol", (0.001, 0.002)),
        f"WITH {O} SELECT symbol, round(exp(sum(ln(1 + 0.001::DOUBLE * r))), 4) AS equity_1, round(exp(sum(ln(1 + 0.002::DOUBLE * r))), 4) AS equity_2 FROM o GROUP BY 1",
    ),
    "report_data_quality": (
        lambda s, d: reports.data_quality(trades(s, d)),
        f"""WITH {T}, g AS (SELECT *, ts_ms // {DAY} AS day, ts_ms - lag(ts_ms) OVER w AS gap, seq < lag(seq) OVER w AS back FROM t WINDOW w AS (PARTITION BY symbol, ts_ms // {DAY} ORDER BY ts_ms, seq))
SELECT symbol, day, count(*) AS n, count(DISTINCT ts_ms // 60000) AS minutes, round(count(DISTINCT ts_ms // 60000) / 1440, 6) AS coverage, max(gap) AS longest_gap, coalesce(NOT bool_or(back), true) AS in_order FROM g GROUP BY 1, 2""",
    ),
    "report_newest": (
        lambda s, d: reports.keep_newest(trades(s, d).select("symbol", "is_sell", "seq"), ["symbol", "is_sell"], "seq", 30),
        f"WITH {T} SELECT symbol, is_sell, seq FROM t QUALIFY row_number() OVER (PARTITION BY symbol, is_sell ORDER BY seq DESC) <= 30",
    ),
    "report_first_by_key": (
        lambda s, d: reports.first_by(trades(s, d).select("symbol", "is_sell", F.round(F.col("price") / 2).alias("key"), "ts_ms", "seq"), ["is_sell", "key"], ["ts_ms", "seq"]),
        f"WITH {T} SELECT symbol, is_sell, round(price / 2) AS key, ts_ms, seq FROM t QUALIFY row_number() OVER (PARTITION BY is_sell, round(price / 2) ORDER BY ts_ms, seq) = 1",
    ),
    "mining_rules": (rules, RULES_SQL),
    "mining_undominated": (
        lambda s, d: mining.undominated(rules(s, d)),
        f"""WITH s AS ({RULES_SQL}), p AS (SELECT rule, avg_r, unnest(string_split(rule, '+')) AS part FROM s WHERE contains(rule, '+')),
x AS (SELECT DISTINCT p.rule FROM p JOIN s ON s.rule = p.part WHERE s.avg_r >= p.avg_r) SELECT s.* FROM s ANTI JOIN x USING (rule)""",
    ),
    "mining_drift": (
        lambda s, d: mining.ks_distance(outcomes(s, d), "price", F.col("ts_ms") >= 1_705_363_200_000, "symbol"),
        f"""WITH {O}, p AS (SELECT symbol, price, count(*) FILTER (ts_ms >= 1705363200000) AS a, count(*) FILTER (ts_ms < 1705363200000) AS b FROM o GROUP BY 1, 2),
g AS (SELECT symbol, a, b, abs(sum(a) OVER w / sum(a) OVER v - sum(b) OVER w / sum(b) OVER v) AS gap FROM p WINDOW w AS (PARTITION BY symbol ORDER BY price), v AS (PARTITION BY symbol))
SELECT symbol, CAST(sum(a) AS BIGINT) AS n_recent, CAST(sum(b) AS BIGINT) AS n_before, round(max(gap), 6) AS ks FROM g GROUP BY 1""",
    ),
    "mining_bootstrap": (lambda s, d: rounded(mining.bootstrap_mean(outcomes(s, d), "symbol", 200), "low", "high"), None),
    "book_features": (books, BOOK_SQL),
    "depth_runs": (runs, None),
    "detector_candidates": (routed, None),
    "paper_account": (simulated, None),
    "cooldown": (
        lambda s, d: structure.cooldown(trades(s, d).select("symbol", "ts_ms", "seq"), "symbol", "ts_ms", 6 * HOUR),
        f"""WITH RECURSIVE {T}, r AS (SELECT symbol, min(ts_ms) AS at FROM t GROUP BY 1 UNION ALL SELECT r.symbol, (SELECT min(t.ts_ms) FROM t WHERE t.symbol = r.symbol AND t.ts_ms >= r.at + {6 * HOUR}) FROM r WHERE r.at IS NOT NULL)
SELECT t.symbol, t.ts_ms, min(t.seq) AS seq FROM t JOIN r ON r.symbol = t.symbol AND r.at = t.ts_ms GROUP BY 1, 2""",
    ),
    "block_states": (
        lambda s, d: structure.block_states(structure.order_blocks(numbered_bars(s, d)), numbered_bars(s, d)).select("symbol", "side", "bucket", "state"),
        f"""WITH {B}, o AS (SELECT *, lead(open) OVER w AS o1, lead(close) OVER w AS c1, lead(open, 2) OVER w AS o2, lead(close, 2) OVER w AS c2, lead(bucket, 2) OVER w AS known FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
s AS (SELECT *, CASE WHEN close < open AND c1 > o1 AND c2 > o2 AND c2 > high THEN 'up' WHEN close > open AND c1 < o1 AND c2 < o2 AND c2 < low THEN 'down' END AS side FROM o),
k AS (SELECT * FROM s WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY bucket DESC) <= 5),
j AS (SELECT k.symbol, k.side, k.bucket, k.high, k.low, min(l.low) AS lo, min(l.close) AS lc, max(l.high) AS hi, max(l.close) AS hc FROM k LEFT JOIN b l ON l.symbol = k.symbol AND l.bucket > k.known GROUP BY 1, 2, 3, 4, 5)
SELECT symbol, side, bucket, CASE WHEN CASE side WHEN 'up' THEN lc < low ELSE hc > high END THEN 'invalidated' WHEN CASE side WHEN 'up' THEN lo <= (high + low) / 2 ELSE hi >= (high + low) / 2 END THEN 'mitigated'
WHEN CASE side WHEN 'up' THEN lo <= high ELSE hi >= low END THEN 'tested' ELSE 'active' END AS state FROM j""",
    ),
    "trailed_trades": (trailed, None),
    "limit_fills": (filled, None),
    "price_chases": (lambda s, d: managers.chases(trades(s, d).select("symbol", "ts_ms", "seq", "price")), None),
} | op.QUERIES
