"""Scans that lose nothing, exact filters, ids after joins, tables that are freed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import facts, stats, steps
from millrace.plans.clean_layers import run_layers
from millrace.plans.runner import Step, build, run_steps
from millrace.sources import scan


def test_json_lines_under_any_name(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text("".join(json.dumps({"a": i}) + "\n" for i in range(10)))
    got = scan.read_json(spark, str(path)).orderBy("_row_id")
    assert [r.a for r in got.collect()] == list(range(10))
    path.write_text("[" + ",\n".join(json.dumps({"a": i}) for i in range(4)) + "]")
    assert scan.read_json(spark, str(path)).count() == 4
    path.write_text('{\n "a": 1\n}')
    assert scan.read_json(spark, str(path)).count() == 1


def test_csv_folder_is_read_in_file_order(spark, tmp_path):
    for name, values in (("a.csv", range(3)), ("b.csv", range(3, 300))):
        (tmp_path / name).write_text("v\n" + "".join(f"{v}\n" for v in values))
    got = scan.read_csv(spark, str(tmp_path))
    assert [r.v for r in got.orderBy("_row_id").collect()] == list(range(300))
    assert got.select("_row_id").distinct().count() == 300


def test_long_integers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993", "1" * 20, "1" * 40), ("9007199254740992", "2" * 20, "2" * 40)], "a string, b string, c string")
    out = scan.narrow_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string"}
    assert out.distinct().count() == 2


def test_parquet_ids_need_no_sort_merge_join_on_files(spark, small, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    df = scan.read_parquet(spark, str(tmp_path / "t"))
    assert df.select("_row_id").distinct().count() == 100
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("column, operator, value, shown", [
    ("o_orderkey", ">=", "1000", "GreaterThanOrEqual(o_orderkey,1000)"),
    ("o_custkey", "==", "37", "EqualTo(o_custkey,37)"),
    ("o_totalprice", "<", 5, "LessThan(o_totalprice,5.0)"),
    ("o_orderkey", "<", 10.5, "LessThan(o_orderkey,11)"),
])
def test_filters_are_pushed_down(spark, small, column, operator, value, shown):
    df = steps.filter_rows(spark.read.parquet(f"{small}/orders.parquet"), column, operator, value)
    assert shown in df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_casts_on_large_whole_numbers(spark):
    big = 9007199254740992
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,), (None,)], "a bigint")
    values = lambda operator, value: sorted(r.a - big for r in steps.filter_rows(df, "a", operator, value).collect() if r.a is not None)
    assert values("==", str(big + 1)) == [1]
    assert values(">", str(big)) == [1, 2]
    assert values("<=", 1e30) == [0, 1, 2] and values(">", 1e30) == []
    assert values("==", 0.5) == [] and steps.filter_rows(df, "a", "!=", 0.5).count() == 4
    text = df.select(F.col("a").cast("string").alias("a"))
    assert sorted(r.a - big for r in steps.change_dtype(text.filter("a IS NOT NULL"), "a", "int").collect()) == [0, 1, 2]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_partners_keep_their_order(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left = spark.createDataFrame([(0, 1), (1, 2)], "_row_id bigint, k int")
        right = spark.createDataFrame([(i, 1, i) for i in range(6)], "_row_id bigint, k int, p int").repartition(5)
        join = Step("join", {"right_dataset": right, "on": "k", "how": "inner"})
        for keep, want in (("first", 0), ("last", 5)):
            got = build(left, [join, Step("remove_duplicates", {"columns": ["k"], "keep": keep})]).collect()
            assert [r.p for r in got] == [want]
        run = run_steps(left, [join, Step("sort_values", {"columns": ["p"], "ascending": False})])
        assert run.status == "success" and run.reports[-1].audit.count() == 0
        run.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_order_survives_a_dropped_sort_column(spark):
    df = spark.createDataFrame([(0, 3, "x"), (1, 1, "x"), (2, 2, "y")], "_row_id bigint, a int, b string")
    plan = [
        Step("sort_values", {"columns": ["a"], "ascending": True}), Step("select_columns", {"columns": ["b"]}),
        Step("remove_duplicates", {"columns": ["b"], "keep": "first"}),
    ]
    assert sorted(r.b for r in build(df, plan).collect()) == ["x", "y"]
    assert [r.a for r in scan.preview(build(df, plan[:1])).collect()] == [1, 2, 3]


def test_runs_and_cleaners_free_what_they_hold(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 4 else 1.0) for i in range(20)], "_row_id bigint, a int, b double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run = run_steps(df, [Step("auto_clean", {}), Step("sort_values", {"columns": ["a"]})], report="counts")
    assert run.status == "success", run.error
    run.release()
    stages: list = []
    build(df, [Step("auto_clean", {})], stages=stages).count()
    for stage in stages:
        stage.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_mixed_records_pass_all_layers(spark):
    records = [{"id": 1, "v": 5}, {"id": 2, "v": "five"}, {"id": 3, "v": 1.5}, {"id": 4, "v": True}, {"id": 4, "v": None}]
    df = scan.from_records(spark, records)
    types = {r["column"]: r for r in facts.cell_types(df).collect()}["v"]
    assert (types.int_cells, types.float_cells, types.bool_cells, types.str_cells, types.other_cells) == (1, 1, 1, 1, 0)
    out = run_layers(df)
    assert out.errors == [] and "mixed_types" in {i.issue_type for i in out.issues}
    entries = {(r["column"], r.action): r["rows"] for r in out.table_audit.collect()}
    assert entries.get(("__all__", "drop_empty_rows")) == 1  # the row with an id and nothing else
    out.release()


def test_order_statistics_narrow_down_skewed_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.exp(rng.standard_normal(20_000) * 8), np.full(15_000, 3.25), [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    ranks = (1, 2, 17_000, 17_501, 17_502, 30_000, len(values))
    got = stats.order_statistics(df, [stats.Ranks("v", F.col("v"), len(values), ranks)], keep=50)
    assert got["v"] == [float(np.sort(values)[r - 1]) for r in ranks]
