"""All registered queries of the market library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import auction, bars, books, detectors, events, files, flow, indicators, intrabar, levels, patterns, phases, profiles, reports, research, scalps

FLAGSHIP = "vwap_session_bands"
QUERIES = bars.QUERIES | indicators.QUERIES | flow.QUERIES | reports.QUERIES | auction.QUERIES | files.QUERIES | patterns.QUERIES | phases.QUERIES | books.QUERIES | profiles.QUERIES | levels.QUERIES | events.QUERIES | intrabar.QUERIES | scalps.QUERIES | research.QUERIES
QUERIES["profile_contiguous_area"] = (QUERIES["profile_contiguous_area"][0], profiles.CONTIGUOUS_SQL)
QUERIES["detector_candidates"] = (QUERIES["detector_candidates"][0], detectors.ROUTED_SQL)
QUERIES["source_book_replay"] = (QUERIES["source_book_replay"][0], books.REPLAY_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries without SQL are state machines, random resamples, and folds; tests hold them against row loops."""
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
