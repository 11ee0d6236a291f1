"""Texts that are judged once however often they occur."""

import math

from pyspark.sql import functions as F

from millrace.operators import facts

TEXTS = ["", " ", None, "true", "TBD", "a@b.co", "12.5", " 5 ", "2020-01-02", "2020-01-02 10:11:12", "3 Jan 2020", "20210304", "1/2/20",
         "Twenty-eight", "seven " * 20, "€5", "-5", "130", "x" * 70, " " * 80 + "7", "1e400", "É" * 40]


def test_facts_of_shared_texts_are_those_of_single_cells(spark, monkeypatch):
    rows = [(t, i * 1.5 if i % 3 else None, None if i % 2 else t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    found = []
    for limit in (facts.SHARED_BYTES, 4, -1):  # -1: every cell by itself
        monkeypatch.setattr(facts, "SHARED_BYTES", limit)
        found.append(facts.collect_facts(facts.column_facts(df)))
    for other in found[1:]:
        for c, f in found[0].items():
            for name, value in f.items():
                again = other[c][name]
                same = math.isclose(value, again, rel_tol=1e-9) or value != value and again != again if isinstance(value, float) else value == again
                assert same, (c, name, value, again)
    assert found[0]["a"]["null_like_wide"] == 3 and found[0]["a"]["row_count"] == 3 * len(TEXTS)


def test_costly_measures_see_each_short_text_once(spark):
    df = spark.range(1000).select(F.concat(F.lit("w"), F.col("id") % 7).alias("a"))
    plan = facts.column_facts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [column" in plan and plan.count("Aggregate") == 3  # cells, different texts, their measures
    assert facts.collect_facts(facts.column_facts(df))["a"]["len_sum"] == 2000
