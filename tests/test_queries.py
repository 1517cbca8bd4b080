"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from marketloom import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype("Float64").astype(float).fillna(-9e99)
        else:
            out[c] = out[c].map(lambda v: "~" if v is None or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    found = catalog.queries()[name](spark, sf_dir).toPandas()
    wanted = sql.sql(catalog.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(plain(found), plain(wanted), check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()


def test_scan_reads_needed_columns_only(spark, sf_dir):
    plan = catalog.queries()["bars_hourly"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_id" in schema and plan.count("Exchange hashpartitioning") == 1
