"""Helpers shared by the training-data operators: table access, shared scratch tables, salting."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus contracts: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else, where one machine runs all, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marketloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch of whole texts: Spark's 10,000 hold tens of MB several times over, in the JVM and in each worker.
BATCH_ROWS = 1_000


@contextmanager
def setting(spark: SparkSession, key: str, value: Any) -> Iterator[None]:
    """A session setting for what runs within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of ``rows`` rows for what is written within; all rows still go through."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows."""
    before = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return batches_of(spark, before if 0 < before <= BATCH_ROWS else BATCH_ROWS)


def shared(spark: SparkSession, what: Any) -> Callable[[], Any]:
    """Broadcast ``what``; the function that a task calls for it.

    Its classes travel as functions do, by value where the package is registered so: executors need not have it installed.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(what))
    return lambda: pickle.loads(packed.value)


def worker_wide(name: str, make: Callable[[], Any]) -> Any:
    """One object for each Python worker, which outlives the task that made it: caches start warm in the next task."""
    store = sys.modules.setdefault("marketloom_worker", types.ModuleType("marketloom_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


class Generations(dict):
    """A bounded cache: when ``bound`` entries are held the older ones go, except those asked for since."""

    def __init__(self, make: Callable[[Any], Any], bound: int):
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        value = self.make(key) if value is None else value
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Scratch:
    """Tables written to the shared folder, to cut lineage.

    A written table survives the loss of executors, and is smaller than a checkpoint of rows. Intermediate ones are
    dropped as soon as their successor is written, all of them by ``finish``, whose table the returned DataFrame reads.
    The caller may call ``close()`` on it; what is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(base)
        files.deleteOnExit(base)

    def path(self, name: str) -> str:
        return self.paths.setdefault(name, f"{self.base}/{name}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # nobody reads the shuffles of a written table again
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(self.paths.pop(name, None))

    def finish(self, df: DataFrame) -> DataFrame:
        """``df``, written as the only table that stays."""
        out = self.save(df, "result")
        self.keep("result")
        return out

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        for name in [n for n in self.paths if n not in names]:
            self.drop(name)

    def close(self) -> None:
        self._delete(self.base)
        self.paths.clear()

    def _delete(self, path: str | None) -> None:
        if path:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with a key of 128 bits over all its columns, and the key's two names: only rows equal throughout share a key."""
    cols = [c for name in df.columns for c in (df[name].isNull(), df[name])]  # the hash passes over nulls
    names = [fresh(df, "_key_a"), fresh(df, "_key_b")]
    return df.select("*", *[F.xxhash64(F.lit(name), *cols).alias(name) for name in names]), names


def thinned(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About ``most`` rows, drawn by a hash of ``by``: each task of a large table sends few of them on."""
    share = min(1.0, most / max(1, df.count()))
    draw = F.shiftrightunsigned(F.xxhash64(*by, F.lit("sample")), 11) / F.lit(float(1 << 53))
    return df.where(draw < share) if share < 1 else df


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_of: Column, salts: int = 16) -> DataFrame:
    """Left join on ``key`` (null matches null) with the right side repeated for each of ``salts``.

    ``right`` has one row for each key. A key that holds a third of the left rows is spread
    over ``salts`` tasks whatever the planner picks; ``right`` must be the small side.
    """
    spread = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    spread = spread.withColumnRenamed(key, "_right_key")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int")).alias("l")
    spread = spread.alias("r")
    on = (F.col("l._salt") == F.col("r._salt")) & F.col(f"l.{key}").eqNullSafe(F.col("r._right_key"))
    return left.join(spread, on, "left").select(
        *[F.col(f"l.{c}") for c in left.columns if c != "_salt"],
        *[F.col(f"r.{c}") for c in spread.columns if c not in ("_salt", "_right_key")],
    )
