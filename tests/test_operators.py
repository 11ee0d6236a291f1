import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, diff, stats, steps
from millrace.operators.fill import fill_missing
from millrace.operators.joins import join_tables
from millrace.operators.ordered import carry_fill
from millrace.rows import number_rows

from .conftest import rows


def table(spark, n=400, seed=1, parts=3):
    rnd = random.Random(seed)
    data = [
        (i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, float(rnd.randint(0, 9))]), rnd.randint(0, 40))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "_row_id bigint, g string, x double, k int").repartition(parts, "k")


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("parts", [1, 17])
def test_carry_fill_equals_pandas(spark, forward, parts):
    df = table(spark, parts=parts)
    pdf = df.toPandas().sort_values("_row_id")
    want = pdf.x.ffill() if forward else pdf.x.bfill()
    got = carry_fill(df, "x", forward, rows_per_range=23).toPandas().sort_values("_row_id")
    pd.testing.assert_series_equal(got.x.reset_index(drop=True), want.reset_index(drop=True))


def test_carry_fill_by_group_equals_pandas(spark):
    df = table(spark).withColumn("g", F.coalesce("g", F.lit("none")))
    pdf = df.toPandas().sort_values("_row_id")
    pdf["x"] = pdf.groupby("g").x.ffill()
    got = carry_fill(df, "x", True, ["g"], rows_per_range=31).toPandas().sort_values("_row_id")
    pd.testing.assert_series_equal(got.x.reset_index(drop=True), pdf.x.reset_index(drop=True))


def test_carry_fill_window_never_spans_the_table(spark):
    plan = carry_fill(table(spark), "x", rows_per_range=50)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("_range" in w.split("],")[-2] + w for w in windows)
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_join_with_split_hot_keys_equals_brute_force(spark, how, null_safe):
    rnd = random.Random(7)
    left = [(i, rnd.choice([1, 1, 1, 1, 2, 3, None, 9]), i * 10) for i in range(120)]
    right = [(rnd.choice([1, 2, 2, 2, 2, 4, None]), -j) for j in range(50)]
    same = lambda a, b: a == b if null_safe else (a is not None and a == b)
    want = [(i, a, v, w) for i, a, v in left for b, w in right if same(a, b)]
    if how in ("left", "outer"):
        want += [(i, a, v, None) for i, a, v in left if not any(same(a, b) for b, _ in right)]
    if how in ("right", "outer"):
        want += [(None, b, None, w) for b, w in right if not any(same(a, b) for _, a, _ in left)]
    lt = spark.createDataFrame(left, "_row_id bigint, k int, v int")
    rt = spark.createDataFrame(right, "k int, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(join_tables(lt, rt, "k", how, null_keys_match=null_safe, hot_rows=5), "_row_id", "k", "v", "w")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted(want, key=repr)


def test_join_suffixes_and_errors(spark):
    a = spark.createDataFrame([(1, "l")], "k int, v string")
    b = spark.createDataFrame([(1, "r")], "k int, v string")
    assert join_tables(a, b, "k").columns == ["k", "v_x", "v_y"]
    with pytest.raises(ValueError, match="left table"):
        join_tables(a, b, "zz")
    with pytest.raises(ValueError, match="unknown join type"):
        join_tables(a, b, "k", "cross")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 1000])
def test_order_statistics_are_exact(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.gauss(0, 100), float(rnd.randint(0, 5))]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    wanted = [stats.Ranks("m", F.col("v"), n, stats.median_ranks(n)), stats.Ranks("top", F.col("v"), n, (n,))]
    got = stats.order_statistics(df, wanted)
    assert sum(got["m"]) / 2 == pytest.approx(float(np.median(values)))
    assert got["top"] == [max(values)]


def test_a_bracket_that_misses_falls_back(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    wrong = stats.Ranks("m", F.col("v"), 101, (51, 51), low=90.0, high=95.0)
    assert stats.order_statistics(df, [wrong]) == {"m": [50.0, 50.0]}


@pytest.mark.parametrize("per_range", [10, 1000])
def test_ks_equals_brute_force(spark, per_range):
    rnd = random.Random(3)
    a = [float(rnd.randint(0, 60)) for _ in range(200)]
    b = [float(rnd.randint(10, 80)) for _ in range(150)]
    grid = sorted(set(a + b))
    want = max(abs(sum(x <= g for x in a) / 200 - sum(x <= g for x in b) / 150) for g in grid)
    frames = [spark.createDataFrame([(v,) for v in vs], "x double") for vs in (a, b)]
    row = diff.diff_distribution(*frames, rows_per_range=per_range).first()
    assert row["ks_stat"] == pytest.approx(round(want, 4))
    assert 0 <= row["ks_pvalue"] < 0.05
    same = diff.diff_distribution(frames[0], frames[0], rows_per_range=per_range).first()
    assert same["ks_stat"] == 0 and same["ks_pvalue"] == 1


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_duplicates_equal_pandas_for_any_partitioning(spark, keep):
    df = table(spark)
    pdf = df.toPandas().sort_values("_row_id")
    for subset in (["g", "x"], None):
        cols = subset or ["g", "x", "k"]
        want = set(pdf.drop_duplicates(cols, keep=keep)._row_id)
        for parts in (1, 17):
            got = steps.remove_duplicates(df.repartition(parts), subset, keep)
            assert {r[0] for r in got.select("_row_id").collect()} == want
            again = steps.remove_duplicates(got, subset, keep)
            assert again.count() == len(want)


def test_number_rows_gives_positions(spark):
    df = table(spark)
    got = number_rows(df, steps.sort_order(df, ["k"], False)).orderBy("_row_id").toPandas()
    assert list(got._row_id) == list(range(400))
    assert got.k.is_monotonic_decreasing


def test_sort_puts_nulls_last_both_ways(spark):
    df = table(spark)
    for up in (True, False):
        values = [r.x for r in steps.sort_values(df, ["x"], up).select("x").collect()]
        assert all(v is None for v in values[-sum(v is None for v in values):])


def test_step_errors_are_raised_while_building(spark):
    df = table(spark)
    for call in (
        lambda: steps.select_columns(df, []), lambda: steps.select_columns(df, ["zz"]), lambda: steps.rename_columns(df, {}),
        lambda: steps.change_dtype(df, "zz", "int"), lambda: steps.change_dtype(df, "x", "blob"),
        lambda: steps.filter_rows(df, "x", "~", 1), lambda: steps.filter_rows(df, "g", ">", 1), lambda: steps.sort_values(df, []),
        lambda: steps.group_aggregate(df, [], {"x": "sum"}), lambda: steps.group_aggregate(df, ["g"], {}),
        lambda: steps.group_aggregate(df, ["g"], {"x": "median"}), lambda: steps.computed_column(df, "", "add", "x", "k"),
        lambda: steps.computed_column(df, "n", "power", "x", "k"), lambda: fill_missing(df, "g", "mean"),
    ):
        with pytest.raises(ValueError):
            call()


def test_cast_to_int_refuses_fractions(spark):
    df = spark.createDataFrame([("1",), ("x",), ("2.5",)], "v string")
    with pytest.raises(Exception, match="fractional"):
        steps.change_dtype(df, "v", "int").collect()
    whole = spark.createDataFrame([("1",), ("x",), ("2.0",)], "v string")
    assert rows(steps.change_dtype(whole, "v", "int")) == [(1,), (2,), (None,)]


def test_truthy_cast(spark):
    df = spark.createDataFrame([("false",), ("",), (None,)], "v string")
    assert [r[0] for r in steps.change_dtype(df, "v", "bool", truthy=True).collect()] == [True, False, False]


def test_audit_matches_row_ids_not_positions(spark):
    df = table(spark)
    after = df.filter("k > 5").withColumn("x", F.coalesce("x", F.lit(-1.0))).orderBy(F.desc("k"))
    entries = audit.audit_cells(df, after)
    assert {r.action for r in entries.select("action").distinct().collect()} == {"fill_null"}
    assert entries.count() == df.filter("k > 5 AND x IS NULL").count()


def test_filter_reaches_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_quantity")
    plan = steps.filter_rows(df, "l_quantity", ">=", 45)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
