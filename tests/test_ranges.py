"""Ranges of similar size over skewed values, and the exact p value of two samples."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import diff, ranges
from millrace.operators.ordered import carry_fill


def long_of(spark, columns):
    rows = [(name, float(v)) for name, values in columns.items() for v in values]
    return spark.createDataFrame(rows, "column string, x double").repartition(5)


@pytest.mark.parametrize("limit", [3, 40, 1000])
def test_ranges_are_small_and_in_order(spark, limit):
    rng = np.random.default_rng(2)
    columns = {
        "skew": np.concatenate([np.exp(rng.standard_normal(1500) * 9), [0.5] * 300, [-1e308, 1.7e308, 1e-300, -1e-300]]),
        "ids": np.arange(1500) + (np.arange(1500) // 100) * (1 << 33), "one": [7.0] * 1500, "few": [1, 2],
        "odd": [math.inf, -math.inf, math.nan] * 500 + [1.0, 2.0],
    }
    long = long_of(spark, columns)
    cuts = ranges.cut_points(long, limit)
    got = ranges.with_range(long, cuts, F.col("x"), F.col("column")).collect()
    assert len(got) == sum(map(len, columns.values()))
    for name, values in columns.items():
        mine = sorted((r["x"], r["_range"]) for r in got if r["column"] == name and math.isfinite(r["x"]))
        numbers = [k for _, k in mine]
        assert numbers == sorted(numbers)
        for k in set(numbers):
            inside = [x for x, j in mine if j == k]
            assert len(inside) <= 2 * limit or len(set(inside)) == 1, (name, k, len(inside))
    assert "one" not in cuts and len(cuts["ids"]) >= 1500 // (2 * limit)


def test_ten_million_skewed_values_and_the_plan(spark):
    x = F.exp(F.randn(5) * 6)
    long = spark.range(10_000_000).select(F.lit("").alias("column"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(x).alias("x"))
    cuts = ranges.cut_points(long, 100_000)
    assert 40 < len(cuts[""]) < 110
    placed = ranges.with_range(long, cuts, F.col("x"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
    assert all(r["n"] <= 200_000 or r["a"] == r["b"] for r in sizes) and sum(r["n"] for r in sizes) == 10_000_000
    order = sorted((r["a"], r["b"]) for r in sizes)
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "percentile" not in plan


def test_search_tree_has_several_levels(spark):
    lows = [-math.inf, *[float(i) for i in range(1, 5000)]]
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    got = ranges.with_range(df, {"": lows}, F.col("x"))
    assert got.filter("x <> _range").count() == 0 and ranges.FANOUT**2 < 5000
    assert ranges.with_range(df.select(F.lit(None).cast("double").alias("x")), {"": lows}, F.col("x")).filter("_range <> 0").count() == 0


def test_fill_over_many_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 101 == 0, F.col("id")).alias("v"))
    got = carry_fill(df.repartition(7), "v", rows_per_range=20)
    assert got.filter("v <> _row_id - _row_id % 101").count() == 0 and got.filter("v IS NULL").count() == 0


def brute_p(a, b):
    """Share of the ways to deal the places to both samples whose statistic reaches that of a and b."""
    n, m = len(a), len(b)
    d = max(abs(Fraction(sum(x <= g for x in a), n) - Fraction(sum(x <= g for x in b), m)) for g in a + b)
    hits = total = 0
    for chosen in itertools.combinations(range(n + m), n):
        mine, i, worst = set(chosen), 0, Fraction(0)
        for t in range(n + m):
            i += t in mine
            worst = max(worst, abs(Fraction(i, n) - Fraction(t + 1 - i, m)))
        hits, total = hits + (worst >= d), total + 1
    return float(Fraction(hits, total))


def test_p_equals_counting_all_orders(spark):
    rng = np.random.default_rng(3)
    for n, m in ((2, 2), (3, 7), (7, 3), (5, 5), (6, 8)):
        for shift in (0.0, 0.8, 9.0):
            a, b = [float(v) for v in rng.normal(size=n)], [float(v) for v in rng.normal(size=m) + shift]
            frames = [spark.createDataFrame([(v,) for v in vs], "x double") for vs in (a, b)]
            assert diff.diff_distribution(*frames).first()["ks_pvalue"] == pytest.approx(round(brute_p(a, b), 4), abs=1e-9)


def test_exact_and_asymptotic_meet(spark):
    p = lambda f, d, n, m: f(F.lit(d), F.lit(n).cast("bigint"), F.lit(m).cast("bigint"))
    row = spark.range(1).select(
        p(diff.ks_exact, 0.06, 900, 1000).alias("exact"), p(diff.ks_asymptotic, 0.06, 900, 1000).alias("limit"),
        p(diff.ks_pvalue, 0.06, 900, 1000).alias("chosen"), p(diff.ks_pvalue, 0.006, 90_000, 100_000).alias("large"),
        p(diff.ks_asymptotic, 0.006, 90_000, 100_000).alias("large_limit"),
    ).first()
    assert row["exact"] == pytest.approx(row["limit"], abs=0.01) and row["chosen"] == row["exact"] != row["limit"]
    assert row["large"] == row["large_limit"]
