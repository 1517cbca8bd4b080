"""Sinks: partitioned Parquet, signal logs, and keyed tables whose newest row counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clocks import DAY


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """One folder for each symbol and UTC day; rows are dealt so that each folder is written by few tasks."""
    day = F.date_format(F.timestamp_millis(F.floor(F.col("bucket") / DAY).cast("long") * DAY), "yyyy-MM-dd")
    bars.withColumn("day", day).repartition("symbol", "day").write.mode(mode).partitionBy("symbol", "day").parquet(path)


def write_log(rows: DataFrame, path: str) -> None:
    """A JSON object a line; arrays and structs stay nested."""
    rows.write.mode("append").json(path)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json"))


def patch(spark: SparkSession, path: str, changes: DataFrame, version: str) -> None:
    """Append new versions of rows; ``latest`` reads the newest of each key."""
    changes.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


class Conflict(RuntimeError):
    """A change was made for another version of a row than the table has."""


def patch_in_place(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], part: str, insert: bool = True, files: int = 1) -> None:
    """Set columns of rows in a table of folders ``part=...``: only the folders that ``changes`` touches are read and written anew.

    ``changes`` has ``part``, ``keys`` and the columns to set; other columns keep their values, rows without a match are inserted, or left
    out without ``insert``. A row of the table carries ``version``, raised with each change; where ``changes`` has ``version`` too it
    must be the one that the table has (null: no row), else nothing is written and ``Conflict`` is raised. Touched folders come out
    as ``files`` files each, so that patches compact them. They are staged beside the table first and replaced by one dynamic
    overwrite, so that the table is whole until then; one writer at a time.
    """
    from pyspark.errors import AnalysisException

    changes = changes.dropDuplicates(keys + [part])
    columns = [c for c in changes.columns if c not in (*keys, part, "version")]
    stage = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        table = None  # nothing there yet
    if table is None:
        table = spark.createDataFrame([], changes.drop("version").withColumn("version", F.lit(0).cast("long")).schema)
    touched = table.join(changes.select(part).distinct(), part, "left_semi")  # folders are pruned by what the changes hold
    named = {c: f"_set_{c}" for c in columns}
    given = changes.select(part, *keys, *[F.col(c).alias(n) for c, n in named.items()], F.lit(True).alias("_hit"), *([F.col("version").alias("_seen")] if "version" in changes.columns else []))
    both = touched.withColumn("_old", F.lit(True)).join(given, [part, *keys], "full_outer")
    if not insert:
        both = both.where("_old")
    clash = F.col("_hit") & ~F.col("_seen").eqNullSafe(F.when(F.col("_old"), F.col("version"))) if "_seen" in both.columns else F.lit(False)
    rest = [c for c in table.columns if c not in (part, *keys, *columns, "version")]
    merged = both.select(
        *keys, *[F.when(F.col("_hit"), F.col(n)).otherwise(F.col(c)).alias(c) if c in table.columns else F.col(n).alias(c) for c, n in named.items()], *rest,
        (F.coalesce("version", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0)).cast("long").alias("version"), part, clash.alias("_clash"),
    )
    merged.write.partitionBy(part).parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    try:
        wrong = staged.where("_clash").count()
        if wrong:
            raise Conflict(f"{wrong} rows have another version")
        spread = [F.pmod(F.xxhash64(*keys), F.lit(files))] if files > 1 else []
        staged.drop("_clash").repartition(part, *spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key; later columns of ``by`` break ties."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def replace_set(rows: DataFrame, path: str, key: str) -> None:
    """Replace the rows of the keys that ``rows`` holds, as one dynamic overwrite of their folders."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
