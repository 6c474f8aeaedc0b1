"""Every registered query of the library's own operators against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from folio import plans


def _views(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return _views(sf_dir)


@pytest.fixture(scope="module")
def larger():
    return _views("/root/testdata/sf0.01")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "~" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = want.fetchall()
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_has_rows(larger, name):
    """A query without rows proves nothing."""
    assert larger.execute(plans.oracle_sql()[name]).fetchone() is not None


@pytest.mark.parametrize("name", ["quantile_impute", "breakout_shelf", "percentile_cutoff"])
def test_running_sums_read_their_rows_once(spark, sf_dir, name):
    """Each running sum reads a written table; nested ones don't multiply the scans of a plan."""
    plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") + plan.count("Scan parquet") <= 24
