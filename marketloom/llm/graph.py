"""Connected components of an edge table, by rounds of minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Tasks over which rows that look up one node are spread.
SALTS = 64


def looked_up(rows: DataFrame, key: str, by: str, found: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``found``, which has one row a ``key``.

    A crowded class has most of its rows look up one node. Rows ask by (key, salt) and each such pair asks once, so
    that a node is asked ``SALTS`` times at most and its rows are dealt over as many tasks; rare keys are not repeated.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    answers = rows.select(key, "salt").distinct().join(found, key)
    return rows.join(answers, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: the smallest node that it reaches.

    Each round moves every node to the smallest label among its neighbours' (hooking the old
    label too), then to its label's label, so that the rounds grow with the logarithm of the
    longest path. All state lives in written tables; only a count comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = looked_up(both, "b", "a", labels.withColumnRenamed("node", "b")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        # the old label hears of the new one: whole trees move, not only their leaves
        told = step.where("next < label").groupBy(F.col("label").alias("node")).agg(F.min("next").alias("told"))
        step = step.join(told, "node", "left").select("node", "label", F.least("next", "told").alias("next"))
        roots = step.select(F.col("node").alias("next"), F.col("next").alias("root"))
        jumped = looked_up(step, "next", "node", roots).select("node", F.least("next", "root").alias("label"), (F.least("next", "root") < F.col("label")).alias("moved"))
        written = scratch.save(jumped, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        labels = written.select("node", "label")
        if written.where("moved").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
