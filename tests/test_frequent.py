"""Frequent values of large tables, digests in place of long texts, digests of whole tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import digests, facts, stats

from .test_joins import run_plan


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def columns():
    rnd = random.Random(6)
    n = 4000
    long = ["text %05d " % i + "x" * 200 for i in range(n)]
    rnd.shuffle(long)
    twice = ["pair %04d " % (i // 2) + "y" * 100 for i in range(n)]
    return {
        "few": [rnd.choice(["a", "b", "B", None, "ccc"]) for _ in range(n)], "skew": ["v%d" % int(rnd.paretovariate(0.7)) for _ in range(n)],
        "long": long, "twice": twice, "one": ["same"] * n, "none": [None] * n,
        "mixed": [long[i] if i % 3 else "often" for i in range(n)],
    }


@pytest.fixture(scope="module")
def table(spark):
    data = columns()
    schema = ", ".join(f"{c} string" for c in data)
    return spark.createDataFrame(list(zip(*data.values())), schema).repartition(5).persist()


@pytest.mark.parametrize("bins", [4096, 16])
@pytest.mark.parametrize("k", [1, 5])
def test_top_values_of_a_large_table(spark, table, monkeypatch, bins, k):
    monkeypatch.setattr(stats, "BINS", bins)
    got = {}
    for r in stats.top_values(table, k=k, plain_bytes=0).collect():
        got.setdefault(r["column"], []).append((r["rank"], r["value"], r["n"]))
    for c, values in columns().items():
        assert [(v, n) for _, v, n in sorted(got.get(c, []))] == top(values, k), c
    assert stats.modes(table, ["skew", "long", "none"], plain_bytes=0) == {c: top(columns()[c], 1)[0][0] for c in ("skew", "long")}


def test_long_distinct_texts_stay_where_they_are(spark, table, monkeypatch):
    """Only digests, and the k smallest texts of each task, pass an exchange."""
    monkeypatch.setattr(stats, "BINS", 16)
    out = stats.top_values(table, ["long"], plain_bytes=0)
    out.collect()
    plan = run_plan(out)
    for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "value" not in exchange or "WindowGroupLimit" in plan
    assert "WindowGroupLimit" in plan and "md5(cast" in plan and "Partial" in plan
    counts = stats.distinct_counts(table, ["long"])
    assert counts.first()["unique_count"] == 4000
    plan = run_plan(counts)
    assert "md5" in plan and not re.search(r"hashpartitioning\([^)]*\bs#", plan)


def test_distinct_counts_of_long_and_odd_texts(spark):
    values = ["A" * 40, "a" * 40, "a" * 32, "A" * 32, "#" + "0" * 32, "#" + "0" * 31, "İ" * 16, "i̇" * 16, "İ" * 17, None, "", "é" * 20, "É" * 20]
    df = spark.createDataFrame([(v,) for v in values * 3], "v string")
    row = stats.distinct_counts(df).first()
    held = {v for v in values if v is not None}
    lowered = df.select(F.lower("v").alias("v")).filter("v IS NOT NULL").distinct().count()
    assert (row["unique_count"], row["unique_folded"]) == (len(held), lowered)


def test_duplicates_by_digest(spark):
    rows = [(1, "a", None, None), (1, None, "a", None), (1, "a", None, None), (None, None, None, 0.0), (None, None, None, -0.0), (None, None, None, float("nan")), (None, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "a int, b string, c string, d double")
    assert facts.duplicate_count(df).first()["duplicate_rows"] == 3
    totals = facts.table_totals(df).first()
    assert (totals["rows"], totals["total_nulls"], totals["duplicate_rows"]) == (7, sum(v is None for r in rows for v in r), 3)
    plan = facts.duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and not re.search(r"hashpartitioning\([^)]*\bb#", plan)
    assert facts.duplicate_count(spark.createDataFrame([], "a string")).first()["duplicate_rows"] == 0


def test_table_digest_sees_rows_not_order(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b"))
    same = df.orderBy(F.desc("b")).repartition(3)
    assert digests.table_digest(df) == digests.table_digest(same)
    assert digests.table_digest(df) == digests.table_digest(df.withColumn("_row_id", F.lit(1)))
    for other in (df.limit(99), df.withColumn("a", F.when(F.col("b") != "5", F.col("a"))), df.withColumnRenamed("a", "c"), df.union(df)):
        assert digests.table_digest(df) != digests.table_digest(other)


def test_unchanged_versions_skip_the_pass_over_copies(spark, monkeypatch):
    from millrace.operators import diff
    from millrace.plans import runner

    monkeypatch.setattr(runner, "MARKED_BYTES", -1)
    counted = []
    count = diff.facts_.table_totals
    monkeypatch.setattr(diff.facts_, "table_totals", lambda df: counted.append(df) or count(df))
    df = spark.range(50).select(F.col("id").alias("_row_id"), (F.col("id") % 5).alias("a"), F.lit("x").alias("b"))
    plan = [
        runner.Step("fill_missing", {"column": "b", "method": "value", "value": "y"}), runner.Step("sort_values", {"columns": ["a"]}),
        runner.Step("filter_rows", {"column": "a", "operator": "<", "value": 2}),
    ]
    run = runner.run_steps(df, plan, report="counts")
    assert run.status == "success", run.error
    # both sides of the first step; nothing for the sort; the new version of the filter
    assert len(counted) == 3
    assert [tuple(r.diff.rows.first()[c] for c in ("row_count_after", "duplicate_after")) for r in run.reports[1:]] == [(50, 45), (50, 45), (20, 18)]
    run.release()
