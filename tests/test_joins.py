"""Joins of multisets: hot keys, equal rows, any partitioning, one evaluation of each side."""

import random
import re
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.joins import join_tables


@contextmanager
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def run_plan(df):
    """The plan as it ran: what stands under a heading of an initial plan is left out."""
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None and at >= skip:
            continue
        skip = at if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def brute(left, right, how, null_safe):
    same = lambda a, b: a == b if null_safe else (a is not None and a == b)
    out = [(a, v, w) for a, v in left for b, w in right if same(a, b)]
    if how in ("left", "outer"):
        out += [(a, v, None) for a, v in left if not any(same(a, b) for b, _ in right)]
    if how in ("right", "outer"):
        out += [(b, None, w) for b, w in right if not any(same(a, b) for a, _ in left)]
    return Counter(out)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_equal_rows_without_ids(spark, monkeypatch, how, null_safe):
    monkeypatch.setattr(joins, "COPIES", 7)
    rnd = random.Random(11)
    left = [(rnd.choice([1, 1, 1, None, None, 2, 9]), rnd.choice(["x", "x", "x", None])) for _ in range(150)]
    right = [(rnd.choice([1, 1, None, 4]), rnd.choice([1.5, 1.5, None])) for _ in range(60)]
    want = brute(left, right, how, null_safe)
    with no_broadcast(spark):
        for parts in (1, 13):
            l = spark.createDataFrame(left, "k int, v string").repartition(parts)
            r = spark.createDataFrame(right, "k int, w double").repartition(parts, "w")
            got = Counter(tuple(x) for x in join_tables(l, r, "k", how, null_keys_match=null_safe, hot_rows=5).collect())
            assert got == want


def test_parts_depend_on_content_alone(spark):
    """No expression that counts rows or draws numbers stands before an exchange: a task that
    runs again deals its rows to the same parts."""
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"))
    with no_broadcast(spark):
        out = join_tables(left, left.withColumnRenamed("v", "w"), "k", "outer", hot_rows=5)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "monotonically_increasing_id" not in plan and "rand" not in plan.lower()
        dealt = joins._tag_parts(joins._bag(left), joins.hot_keys(joins._bag(left), joins._bag(left), ["k"], 5), ["k"], "_sl", "_sr", "_a", "_b")
        again = joins._tag_parts(joins._bag(left.repartition(31)), joins.hot_keys(joins._bag(left), joins._bag(left), ["k"], 5), ["k"], "_sl", "_sr", "_a", "_b")
        assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, again.collect()))


def test_a_hot_key_lies_in_several_parts(spark):
    left = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("w"))
    tagged = joins._tag_parts(joins._bag(left), joins.hot_keys(joins._bag(left), joins._bag(right), ["k"], 100), ["k"], "_sl", "_sr", "_a", "_b")
    sizes = [r["count"] for r in tagged.groupBy("_a").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200
    one = left.withColumn("v", F.lit(0))  # one row 2000 times: dealt as rows with a count
    tagged = joins._tag_parts(joins._bag(one), joins.hot_keys(joins._bag(one), joins._bag(right), ["k"], 100), ["k"], "_sl", "_sr", "_a", "_b")
    assert tagged.agg(F.sum("_n"), F.max("_n")).first()[:] == (2000, joins.COPIES)


@pytest.mark.parametrize("ids", [True, False])
def test_each_side_is_read_once(spark, small, ids):
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_custkey", "o_orderstatus", *([F.col("o_orderkey").alias("_row_id")] if ids else []))
    customers = spark.read.parquet(f"{small}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    with no_broadcast(spark):
        out = join_tables(orders, customers, "o_custkey", "outer", hot_rows=10)
        out.collect()
        plan = run_plan(out)
    files = re.findall(r"FileScan parquet \[[^\]]*\].*?(customer|orders)\.parquet", plan)
    assert Counter(files) == {"customer": 1, "orders": 1}, plan


def test_columns_that_cannot_be_grouped(spark):
    df = spark.sql("SELECT id % 2 AS k, map('a', id % 3) AS m, parse_json(CAST(id % 3 AS STRING)) AS j FROM range(60)")
    other = spark.sql("SELECT 0L AS k, 'z' AS z UNION ALL SELECT 5L, 'y'")
    with no_broadcast(spark):
        got = join_tables(df, other, "k", "outer", hot_rows=5)
        assert got.count() == 61 and got.filter("z = 'z'").count() == 30
