"""What is known of a version is used for the comparison and for the next version, with the same results."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import anomalies, issues, stats
from millrace.plans import clean_layers, runner
from millrace.plans.runner import Step, kept_columns, run_steps

SCHEMA = "_row_id bigint, k bigint, x double, s string, flag boolean, nothing string"


def _rows(spark, n=60, shift=0):
    rows = [
        (i, i % 7 + shift, None if i % 5 == 0 else float(i % 11), None if i % 6 == 0 else ("A", "a", " b ", "7", "x" * 70)[i % 5], i % 2 == 0, None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:4])], SCHEMA)


def _all(d):
    parts = (d.rows, d.columns, d.nulls, d.drift, d.categories, d.distribution)
    return [sorted(map(repr, p.collect())) for p in parts]


def _same_numbers(one, other):
    for a, b in zip(one, other):
        assert len(a) == len(b)
    assert [a for i, a in enumerate(one) if i != 3] == [b for i, b in enumerate(other) if i != 3]


def test_a_comparison_from_evidence_is_the_counted_one(spark):
    before = _rows(spark)
    empty = before.filter("k < 0")
    for after in (before.filter("k > 2"), _rows(spark, 40, 1).withColumn("s", F.lit(3)).drop("flag"), empty):
        known = issues.gather(before), issues.gather(after)
        counted, told = anomalies.compute_diff(before, after), anomalies.compute_diff(before, after, known=known)
        _same_numbers(_all(counted), _all(told))
        means = [{r["column"]: r.asDict() for r in d.drift.collect()} for d in (counted, told)]
        assert means[0].keys() == means[1].keys()
        for c in means[0]:
            assert {k: v if k == "column" else pytest.approx(v) for k, v in means[0][c].items()} == means[1][c]


def test_columns_that_a_step_keeps_are_not_counted_again(spark, monkeypatch):
    before = _rows(spark)
    step = Step("add_computed_column", {"new_column": "y", "operation": "add", "col_a": "x", "constant_value": 1})
    after = runner.apply_step(before, step)
    kept = kept_columns(step, before, after)
    assert kept == ("k", "x", "s", "flag", "nothing")
    known = issues.gather(before)
    asked = []
    counts = stats.distinct_counts
    monkeypatch.setattr(stats, "distinct_counts", lambda df, columns, exact=True: asked.append(columns) or counts(df, columns, exact))
    found = issues.gather(after, known=known, kept=kept)
    assert asked == [["y"]]
    monkeypatch.undo()
    whole = issues.gather(after)
    assert found.held.keys() == whole.held.keys() and found.unique == whole.unique and found.folded == whole.folded
    assert (found.rows, found.duplicate_rows, found.null_cells) == (whole.rows, whole.duplicate_rows, whole.null_cells)
    for c in whole.held:
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in whole.held[c].items()} == found.held[c]
    told = anomalies.compute_diff(before, after, known=(known, found), kept=kept)
    _same_numbers(_all(anomalies.compute_diff(before, after)), _all(told))


def test_a_replaced_column_is_not_kept(spark):
    before = _rows(spark)
    step = Step("add_computed_column", {"new_column": "x", "operation": "add", "col_a": "x", "constant_value": 1})
    assert "x" not in kept_columns(step, before, runner.apply_step(before, step))
    assert kept_columns(Step("filter_rows", {"column": "k", "operator": ">", "value": 1}), before, before) == ()


def test_a_full_run_counts_copies_once_a_version_and_nothing_after_a_sort(spark, monkeypatch):
    from millrace.operators import facts

    plan = [
        Step("filter_rows", {"column": "k", "operator": ">", "value": 1}),
        Step("sort_values", {"columns": ["k"], "ascending": False}),
    ]
    calls = []
    for name in ("table_totals", "duplicate_count"):
        old = getattr(facts, name)
        monkeypatch.setattr(facts, name, lambda *a, _old=old, _name=name, **k: calls.append(_name) or _old(*a, **k))
    run = run_steps(_rows(spark), plan, report="full")
    assert run.status == "success" and not run.reports[1].errors
    assert calls == ["duplicate_count"] * 2
    one, two = ({r["column"]: r.asDict() for r in r.stats.collect()} for r in run.reports[1:])
    assert one == two
    again = run_steps(run.reports[1].df.localCheckpoint(), [], report="full").reports[0].stats
    assert {r["column"]: r.asDict() for r in again.collect()} == one
    assert run.reports[2].score.first()["improvement"] == 0.0
    run.release()


def test_the_cleaned_table_is_held_for_its_score(spark):
    done = clean_layers.run_layers(_rows(spark), strict=True)
    assert done.df.storageLevel.useMemory
    done.release()


def test_whole_numbers_are_told_apart_exactly(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big, 1, "a"), (big + 1, 1, "A"), (None, 2, "a")], "b bigint, i int, s string")
    got = {r["column"]: (r["unique_count"], r["unique_folded"]) for r in stats.distinct_counts(df).collect()}
    assert got == {"b": (2, 2), "i": (2, 2), "s": (2, 1)}
