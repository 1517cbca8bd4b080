"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken ``target / source size`` times. The fractional part is
rounded by pairs: of two documents of a source with fractional probabilities, one gives words to the
other (in a direction drawn so that no expectation changes) until one probability is 0 or 1. A pair's
expected words stay as they are, so a source's words miss its target by less than one document.

The pairing runs as a tree: first within ``LEAVES`` or more groups of documents by hash (a hot source
is spread over all of them), each leaving one fractional document for a source at most; these meet in
ever fewer groups, each ``FAN`` times fewer, until a source has one left, which is drawn alone.
Draws come from hashes of the document and the level, so reruns agree.

Edge cases: a null or blank text has size 0 and takes 0 words; sources are in order of code points with
null last; a null doc_id is hashed as such; repeated rows are rounded each for itself. If all
sizes are 0, targets are 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, keyed, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEAVES = 256
FAN = 32
ROWS = 20_000
EPS = 1e-9
DRAWN = "doc_id long, source string, size long, copies long, p double, u double, bucket long"
BY = ("doc_id", "source")


def sized(docs: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.cast("long").alias("size"), *key)


def ordered_sources(sizes: DataFrame, scratch: Scratch, groups: int = 64) -> DataFrame:
    """``source, source_size, nth`` with sources numbered by code point, null last, without one task for all."""
    per = scratch.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "per-source")
    last = F.col("source").isNull()
    ranged = per.withColumn("is_null", last).repartitionByRange(groups, "is_null", "source").withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")  # the numbering below must see the same parts twice
    counts = ranged.groupBy("part").count()  # at most `groups` rows
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("is_null", "source")) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(before), "part").select("source", "source_size", (F.col("nth") + F.col("before")).alias("nth"))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target``: targets proportional to weights, held at ``most`` times the source."""
    weight: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    src = scratch.save(ordered_sources(sizes, scratch).withColumn("weight", weight), "sources")
    cap = F.col("source_size") * F.lit(most)
    whole = src.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, held = 0.0, -1
    while whole:  # only sums come to the driver; every round holds more sources
        over = F.col("weight") * F.lit(level) > cap
        got = src.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(over).alias("held"),
        ).first()
        if got["held"] == held or not got["free"]:
            break
        held, level = got["held"], (share * whole - got["fixed"]) / got["free"]
    return scratch.save(src.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target")), "targets")


def pivot(rows: pd.DataFrame, key: Sequence[str] = ()) -> pd.DataFrame:
    """Round pairs one after the other within each source; at most one row for a source stays fractional."""
    rows = rows.sort_values(["u", "doc_id", "size", *key], kind="stable").reset_index(drop=True)
    p, size, u = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(), rows["u"].to_numpy()
    hold: dict[object, int] = {}
    for j, source in enumerate(rows["source"].where(rows["source"].notna(), None)):
        if not 0.0 < p[j] < 1.0:
            continue
        i = hold.get(source)
        if i is None:
            hold[source] = j
            continue
        up = min(size[i] * (1.0 - p[i]), size[j] * p[j])  # words that i may gain from j
        down = min(size[i] * p[i], size[j] * (1.0 - p[j]))
        words = up if u[j] * (up + down) < down else -down
        p[i] += words / size[i]
        p[j] -= words / size[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < EPS else 1.0 if p[k] > 1.0 - EPS else p[k]
        open_now = [k for k in (i, j) if 0.0 < p[k] < 1.0]
        if open_now:
            hold[source] = open_now[0]
            continue
        del hold[source]
    rows["p"] = p
    return rows


def draw(level: int, by: Sequence[str] = BY) -> Column:
    bits = F.xxhash64(*by, F.lit(level))
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, key: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    With ``key``, long columns that tell rows apart: these too, and draws are by them and not by doc_id.
    """
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(sized(docs, key), "sizes")
    by, drawn = key or BY, DRAWN + "".join(f", `{k}` long" for k in key)
    goal = targets(sizes, scratch, weights, share, most)
    leaves = max(LEAVES, -(-sizes.count() // ROWS))
    g = goal.withColumnRenamed("source", "g_source").select("g_source", "source_size", "target")
    wanted = sizes.join(g, F.col("source").eqNullSafe(F.col("g_source")), "left")
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    bucket = F.pmod(F.xxhash64(*(key or ["doc_id", "source", "size"]), F.lit("bucket")), F.lit(leaves)).cast("long")
    start = wanted.select(
        "doc_id", "source", "size", F.floor(rate).cast("long").alias("copies"),
        (rate - F.floor(rate)).alias("p"), draw(0, by).alias("u"), bucket.alias("bucket"), *key,
    )
    done = scratch.save(start.groupBy("bucket").applyInPandas(lambda rows: pivot(rows, key), drawn), "level-0")
    decided = [done.where("p <= 0 or p >= 1")]
    groups, level = leaves, 0
    while groups > 1:
        groups, level = -(-groups // FAN), level + 1
        rest = done.where("p > 0 and p < 1").withColumn("u", draw(level, by)).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        # many sources are spread by hash as well; those of one source stay together
        rest = rest.withColumn("_by", F.pmod(F.xxhash64("source"), F.lit(LEAVES)))
        done = scratch.save(rest.groupBy("bucket", "_by").applyInPandas(lambda rows: pivot(rows.drop(columns="_by"), key), drawn), f"level-{level}")
        decided.append(done.where("p <= 0 or p >= 1"))
    alone = done.where("p > 0 and p < 1").withColumn("p", (draw(-1, by) < F.col("p")).cast("double"))
    rounded = alone
    for part in decided:
        rounded = rounded.unionByName(part)
    taken = (F.col("copies") + F.col("p").cast("long")) * F.col("size")
    out = rounded.select("doc_id", "size", "source", taken.alias("taken"), *key)
    out = out.join(g, F.col("source").eqNullSafe(F.col("g_source")), "left")
    return scratch.finish(out.select("doc_id", "size", "source_size", "target", "taken", *key))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, whatever its doc_id; rows equal throughout are one, taken as often as all of them."""
    rows, key = keyed(docs)
    copies, copy = fresh(docs, "_copies"), fresh(docs, "_copy")
    taken = mix(spark, rows, key=key).where("taken > 0").groupBy(key).agg(F.sum(F.expr("taken div size")).cast("int").alias(copies))
    kept = rows.join(taken, key).dropDuplicates(key)
    return kept.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))
