"""Rule mining on boolean conditions, resampling, and drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import rate


def conditions(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """``holds``: names of the conditions that hold in each row, in order of names."""
    return rows.withColumn("holds", F.array_compact(F.array(*[F.when(c, n) for n, c in sorted(named.items())])))


def combinations(rows: DataFrame, least: int, depth: int = 2) -> DataFrame:
    """Results of the rows in which one condition, or each pair or triple of them, holds.

    A row names a bounded number of conditions, so its combinations are as well; their sums combine before
    the shuffle.
    """
    holds = F.col("holds")
    one = F.transform(holds, lambda a: F.array(a))
    sets = one
    for _ in range(depth - 1):
        sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter(holds, lambda b: b > F.element_at(s, -1)), lambda b: F.concat(s, F.array(b)))))
        one = F.concat(one, sets)
    met = rows.select("r", F.explode(one).alias("names"))
    wins = F.count_if(F.col("r") > 0)
    stats = met.groupBy(F.array_join("names", "+").alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), rate(wins, F.count(F.lit(1))).alias("win_rate"), F.round(F.avg("r"), 6).alias("avg_r"), F.round(F.sum("r"), 6).alias("sum_r")
    )
    return stats.where(F.col("n") >= least)


def undominated(stats: DataFrame) -> DataFrame:
    """Rules without a shorter one inside them that has at least their mean result."""
    parts = stats.withColumn("part", F.explode(F.split("rule", r"\+"))).where("rule <> part")
    alone = stats.select(F.col("rule").alias("part"), F.col("avg_r").alias("part_r")).where(~F.col("rule").contains("+"))
    beaten = parts.join(alone, "part").where("part_r >= avg_r").select("rule").distinct()
    return stats.join(beaten, "rule", "left_anti")


def permutation_null(rows: DataFrame, block: list[str], order: str, permutations: int) -> DataFrame:
    """For each single condition of ``holds`` its mean result, and the share of permutations whose best condition does as well.

    Results are shuffled within blocks (a symbol's day, say), which keeps each block's level and bounds what one task holds;
    the draws are hashes of the permutation and ``order``, so reruns agree.
    """
    by = Window.partitionBy(*block).orderBy(order)
    placed = rows.select(*block, "holds", "r", F.row_number().over(by).alias("place"), F.col(order).alias("_o"))
    copies = placed.select(*block, "_o", F.col("r").alias("drawn"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("k"))
    draw = F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("_o").cast("string")).cast("binary"))
    copies = copies.withColumn("place", F.row_number().over(Window.partitionBy(*block, "k").orderBy(draw, "_o"))).drop("_o")
    # Spark's estimate knows nothing of the copies: without the hint it broadcasts them
    met = placed.join(copies.hint("merge"), [*block, "place"]).select("k", "drawn", F.explode("holds").alias("rule"))
    best = met.groupBy("k", "rule").agg(F.avg("drawn").alias("mean")).groupBy("k").agg(F.max("mean").alias("best"))  # a row for each permutation
    found = rows.select("r", F.explode("holds").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))
    nulls = best.agg(F.collect_list("best").alias("all"))  # one row
    as_good = F.size(F.filter("all", lambda x: x >= F.col("mean")))
    return found.join(F.broadcast(nulls)).select("rule", "n", F.round("mean", 6).alias("avg_r"), ((as_good + 1) / (permutations + 1)).alias("p"))


def bootstrap_mean(rows: DataFrame, key: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """2.5 % and 97.5 % bounds of the mean of ``r`` by key, by Poisson resampling.

    Every row takes part in each resample with a Poisson(1) weight from its own seed: sums over parts of the data
    add up, so no key's rows ever meet in one task.
    """

    def weigh(batches):
        for batch in batches:
            for k, part in batch.groupby(key, dropna=False):
                sums, counts = np.zeros(resamples), np.zeros(resamples)
                for at in range(0, len(part), 512):
                    some = part.iloc[at : at + 512]
                    w = np.stack([np.random.default_rng([seed, int(s) & 0xFFFFFFFF]).poisson(1.0, resamples) for s in some["seq"]])
                    sums += some["r"].to_numpy() @ w
                    counts += w.sum(axis=0)
                yield pd.DataFrame({key: k, "i": np.arange(resamples), "s": sums, "c": counts})

    parts = rows.select(key, "seq", "r").mapInPandas(weigh, f"{key} string, i int, s double, c double")
    means = parts.groupBy(key, "i").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0.0))).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def ks_distance(rows: DataFrame, value: str, recent: Column, key: str) -> DataFrame:
    """Largest gap between the distribution of recent rows and that of the others, by key and distinct values."""
    from pyspark.sql import Window

    per = rows.groupBy(key, value).agg(F.count_if(recent).alias("a"), F.count_if(~recent).alias("b"))
    run, whole = Window.partitionBy(key).orderBy(value), Window.partitionBy(key)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(whole) - F.sum("b").over(run) / F.sum("b").over(whole))
    return per.withColumn("gap", gap).groupBy(key).agg(F.sum("a").alias("n_recent"), F.sum("b").alias("n_before"), F.round(F.max("gap"), 6).alias("ks"))


def fill_model(rows: DataFrame, features: list[str], label: str):
    """Logistic regression of fills, ridge penalty; returns the fitted model of pyspark.ml."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return LogisticRegression(labelCol=label, regParam=1.0 / max(1, rows.count()), elasticNetParam=0.0).fit(assembled)


def importance(rows: DataFrame, features: list[str], label: str, trees: int = 20) -> dict[str, float]:
    """Importance of each feature in a random forest of pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    fitted = RandomForestRegressor(labelCol=label, numTrees=trees, seed=7).fit(assembled)
    return dict(zip(features, map(float, fitted.featureImportances.toArray()), strict=True))
