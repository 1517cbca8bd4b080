"""Corpus pipeline: language ID, SimHash near-dedup, personal data, source mixing, best-fit packing.

Each stage takes all its predecessor kept, as written Parquet, and returns a DataFrame; all but the last
return the columns of documents. Documents in no language go; of near-duplicates the one with the
smallest id stays (null last; rows are told apart by all their columns, not by id); personal data is replaced by its kind; every document is repeated as often as
the mix of sources takes it; the last stage returns the pieces of documents with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import language, mixing, packing, pii, simhash
from marketloom.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", lambda spark, docs, sf_dir: language.keep_identified(spark, docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.keep_first(spark, docs)),
    ("personal_data", lambda spark, docs, sf_dir: pii.redacted(spark, docs)),
    ("source_mix", lambda spark, docs, sf_dir: mixing.mixed(spark, docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: packing.best_fit(spark, docs, cache=packing.STAGE_CACHE, keep=False)),
]
#: Learned models, drawn copies and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
