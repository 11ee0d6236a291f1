"""Every registered query compiles; a sample is compared with its SQL text."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import normal, rows_of

SAMPLE = (
    "step_divide", "step_cast_int", "filter_ne_nulls", "drop_missing_thresh", "join_outer", "join_null_keys",
    "group_aggregate_first_last", "fill_median", "ffill", "dedup_subset", "norm_dates_careful", "column_stats", "diff_nulls",
    "diff_ks", "audit_cells", "issues_layer3", "clean_smart", "catalog_save_once", "usage_remaining", "scenario_result",
)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert normal(float("nan")) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
