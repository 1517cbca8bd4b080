"""Registered queries: candle shapes and sequences, mining with a permutation null, session baselines, rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import DAY, region
from ..operators import mining, patterns
from .auction import last
from .base import B, O, hourly, outcomes, rounded
from .indicators import ORDER

NAMES = ("shooting_star", "hammer", "full_up", "full_down")
SHAPES = f"""{B}, c0 AS (SELECT *, high - low + 1e-9 AS z, abs(close - open) AS bd, high - greatest(close, open) AS wu, least(close, open) - low AS wd FROM b),
c AS (SELECT *, wu / z > 0.45::DOUBLE AND bd / z < 0.4::DOUBLE AS shooting_star, wd / z > 0.45::DOUBLE AND bd / z < 0.4::DOUBLE AS hammer, bd / z > 0.8::DOUBLE AND close > open AS full_up, bd / z > 0.8::DOUBLE AND close < open AS full_down FROM c0),
q AS (SELECT *, {', '.join(f"coalesce(lag({n}) OVER {ORDER}, false) AS {n}_before, bool_or({n}) OVER {last(2)} AS {n}_recent" for n in NAMES)}, lead(close, 3) OVER {ORDER} / close - 1 AS r FROM c)"""
ALL_NAMES = [f"{n}{tail}" for n in NAMES for tail in ("", "_before", "_recent")]


def shaped(s, d):
    return patterns.sequences(hourly(s, d), patterns.candle_shapes())


def sequence_rules(s, d):
    rows = shaped(s, d).withColumn("r", patterns.forward_result(3)).where("r is not null")
    return mining.undominated(mining.combinations(mining.conditions(rows, {n: F.col(n) for n in ALL_NAMES}), 20))


def null(s, d):
    named = {"big": F.col("qty") >= 60, "sell": F.col("is_sell"), "cheap": F.col("price") < 15, "asia": region(F.col("ts_ms")) == "asia"}
    rows = mining.conditions(outcomes(s, d), named).withColumn("day", F.floor(F.col("ts_ms") / DAY).cast("long"))
    return mining.permutation_null(rows, ["symbol", "day"], "seq", 20)


def baselines(s, d):
    b = hourly(s, d).withColumn("cvd", F.sum("delta").over(patterns.rows(-500)))
    out = patterns.session_baseline(b, "cvd", F.when(F.col("volume") > 100, F.col("delta")).otherwise(0))
    return out.select("symbol", "bucket", "cvd_session", "large_session", "volume_session")


def features(s, d):
    made = ("delta_10", "volume_10", "return_10", "delta_30", "volume_30", "return_30", "large", "imbalance")
    return rounded(patterns.rolling_features(hourly(s, d)).select("symbol", "bucket", *made), *made)


def over(f: str, k: int) -> str:
    return f"CASE WHEN count(*) OVER {last(k - 1)} >= {max(5, k // 4)} THEN {f} OVER {last(k - 1)} END"


QUERIES = {
    "candle_sequences": (lambda s, d: shaped(s, d).select("symbol", "bucket", *ALL_NAMES), f"WITH {SHAPES} SELECT symbol, bucket, {', '.join(ALL_NAMES)} FROM q"),
    "sequence_rules": (
        sequence_rules,
        f"""WITH {SHAPES}, i AS (SELECT row_number() OVER () AS id, r, unnest(list_filter([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in sorted(ALL_NAMES))}], lambda v: v IS NOT NULL)) AS n FROM q WHERE r IS NOT NULL),
k AS (SELECT n AS rule, r FROM i UNION ALL SELECT a.n || '+' || b.n, a.r FROM i a JOIN i b ON a.id = b.id AND a.n < b.n), s AS (SELECT rule, count(*) AS n, round(count(*) FILTER (r > 0) / count(*), 4) AS win_rate, round(avg(r), 6) AS avg_r, round(sum(r), 6) AS sum_r FROM k GROUP BY 1 HAVING count(*) >= 20),
p AS (SELECT rule, avg_r, unnest(string_split(rule, '+')) AS part FROM s WHERE contains(rule, '+')), x AS (SELECT DISTINCT p.rule FROM p JOIN s ON s.rule = p.part WHERE s.avg_r >= p.avg_r) SELECT s.* FROM s ANTI JOIN x USING (rule)""",
    ),
    "mining_null": (
        null,
        f"""WITH {O}, h AS (SELECT symbol, ts_ms // {DAY} AS day, seq, r::DOUBLE AS r, list_filter([CASE WHEN ts_ms % {DAY} // 60000 < 480 THEN 'asia' END, CASE WHEN qty >= 60 THEN 'big' END, CASE WHEN price < 15 THEN 'cheap' END, CASE WHEN is_sell THEN 'sell' END], lambda v: v IS NOT NULL) AS holds FROM o),
a AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY seq) AS place FROM h), k AS (SELECT symbol, day, r AS drawn, g.range AS k, row_number() OVER (PARTITION BY symbol, day, g.range ORDER BY md5(g.range || ':' || seq), seq) AS place FROM h, range(20) g),
m AS (SELECT k.k, k.drawn, unnest(a.holds) AS rule FROM a JOIN k USING (symbol, day, place)), n AS (SELECT k, max(mean) AS best FROM (SELECT k, rule, avg(drawn) AS mean FROM m GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT rule, count(*) AS n, avg(r) AS mean FROM (SELECT r, unnest(holds) AS rule FROM h) GROUP BY 1) SELECT rule, n, round(mean, 6) AS avg_r, ((SELECT count(*) FROM n WHERE best >= mean) + 1) / 21 AS p FROM f""",
    ),
    "session_baselines": (
        baselines,
        f"""WITH {B}, x AS (SELECT *, sum(delta) OVER {last(500)} AS cvd, bucket % {DAY} // 60000 AS m FROM b), y AS (SELECT *, CASE WHEN m >= 780 AND m < 960 THEN 'overlap' WHEN m >= 780 AND m < 1260 THEN 'new_york' WHEN m >= 480 AND m < 960 THEN 'london' WHEN m < 480 THEN 'asia' ELSE 'off_hours' END AS g FROM x),
z AS (SELECT *, CAST(g <> coalesce(lag(g) OVER {ORDER}, 'off_hours') AND g IN ('asia', 'london', 'new_york') AS INT) AS begins FROM y), r AS (SELECT *, sum(begins) OVER (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run FROM z)
SELECT symbol, bucket, CAST(cvd - CASE WHEN run > 0 THEN first_value(cvd) OVER w ELSE 0 END AS BIGINT) AS cvd_session, CAST(sum(CASE WHEN volume > 100 THEN delta ELSE 0 END) OVER w AS BIGINT) AS large_session, CAST(sum(volume) OVER w AS BIGINT) AS volume_session
FROM r WINDOW w AS (PARTITION BY symbol, run ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
    ),
    "rolling_features": (
        features,
        f"""WITH {B} SELECT symbol, bucket, {', '.join(f"round({over('sum(delta)', k)} / (({over('stddev_samp(delta)', 120)} + 1e-9) * sqrt({k})), 6) AS delta_{k}, round({over('sum(volume)', k)} / ({over('avg(volume)', 120)} * {k} + 1e-9), 6) AS volume_{k}, round((close / lag(close, {k}) OVER {ORDER} - 1) * 1e4, 6) AS return_{k}" for k in (10, 30))},
round((volume - {over('avg(volume)', 120)}) / ({over('stddev_samp(volume)', 120)} + 1e-9), 6) AS large, round(({over('sum(buy_qty)', 30)} - {over('sum(sell_qty)', 30)}) / ({over('sum(buy_qty)', 30)} + {over('sum(sell_qty)', 30)} + 1e-9), 6) AS imbalance FROM b""",
    ),
}
