"""Snapshots that are whole or not there, runs saved twice, and re-runs after an edit."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.runner import Step, edit_step, run_steps
from millrace.plans.versions import Versions, run_versioned, source_digest
from millrace.sources.registry import Registry

PLAN = [
    Step("filter_rows", {"column": "k", "operator": ">", "value": 10}),
    Step("fill_missing", {"column": "x", "method": "value", "value": 0}),
    Step("add_computed_column", {"new_column": "y", "operation": "add", "col_a": "x", "col_b": "k"}),
]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.range(200).select(F.col("id").alias("_row_id"), (F.col("id") % 50).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x")).write.parquet(path)
    return path


def test_a_save_that_fails_halfway_is_invisible(spark, source, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    run = run_steps(spark.read.parquet(source), PLAN, report="counts")
    report = run.reports[1]
    broken = report.explanations
    report.explanations = spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        registry.save_snapshot(run, report)
    assert registry.commits().count() == 0
    with pytest.raises(ValueError, match="no stored"):
        registry.snapshots(run.run_id)
    report.explanations = broken
    for _ in range(2):  # the second save takes the place of the first
        for r in run.reports:
            registry.save_snapshot(run, r)
    assert registry.commits(run.run_id).count() == 4
    assert [r.row_count for r in registry.snapshots(run.run_id).collect()] == [200, 156, 156, 156]
    assert registry.snapshots(run.run_id, "nulls").filter("step_index = 1").count() == 2
    for _ in range(3):
        registry.save_run(run, PLAN)
    row = registry.runs().collect()
    assert len(row) == 1 and row[0]["status"] == "success" and len(row[0]["plan"].splitlines()) == 3
    assert row[0]["started_at"] is not None
    run.release()


def test_only_steps_from_the_change_on_run(spark, source, tmp_path):
    versions, calls = Versions(spark, str(tmp_path / "versions")), []
    save = versions.save
    versions.save = lambda df, digest: calls.append(digest) or save(df, digest)
    df = spark.read.parquet(source)
    first = run_versioned(df, PLAN, versions)
    assert first.computed == [1, 2, 3] and len(calls) == 3
    again = run_versioned(spark.read.parquet(source), PLAN, versions)
    assert again.computed == [] and len(calls) == 3 and again.digests == first.digests
    renamed = [Step(s.step_type, s.config, name="other name") for s in PLAN]
    assert run_versioned(df, renamed, versions).computed == []
    edited = edit_step(PLAN, PLAN[2].step_id, config=PLAN[2].config | {"operation": "subtract"})
    last = run_versioned(df, edited, versions)
    assert last.computed == [3] and last.reused == [1, 2] and len(calls) == 4
    assert last.df.agg(F.sum("y")).first()[0] == last.df.agg(F.sum(F.col("x") - F.col("k"))).first()[0]
    off = edit_step(PLAN, PLAN[1].step_id, enabled=False)
    assert run_versioned(df, off, versions).computed == [2]  # the first step is reused, the third runs on other input


def test_a_changed_source_is_another_one(spark, source, tmp_path):
    versions = Versions(spark, str(tmp_path / "versions"))
    before = source_digest(spark.read.parquet(source))
    run_versioned(spark.read.parquet(source), PLAN, versions)
    spark.range(5).select(F.col("id").alias("_row_id"), F.col("id").alias("k"), F.lit(1.0).alias("x")).write.mode("append").parquet(source)
    spark.catalog.refreshByPath(source)
    assert source_digest(spark.read.parquet(source)) != before
    assert run_versioned(spark.read.parquet(source), PLAN, versions).computed == [1, 2, 3]
    local = spark.createDataFrame([(0, 20, 1.0)], "_row_id bigint, k bigint, x double")
    with pytest.raises(ValueError, match="source_key"):
        run_versioned(local, PLAN, versions)
    assert run_versioned(local, PLAN, versions, source_key="mine").computed == [1, 2, 3]


def test_a_half_written_version_does_not_count(spark, source, tmp_path):
    versions = Versions(spark, str(tmp_path / "versions"))
    run = run_versioned(spark.read.parquet(source), PLAN, versions)
    (tmp_path / "versions" / run.digests[2] / "_SUCCESS").unlink()
    assert run_versioned(spark.read.parquet(source), PLAN[:2], versions).computed == [2]


def test_table_issues_of_a_run(spark):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit("c").alias("c"), F.when(F.col("id") < 5, F.col("id")).alias("part_id"))
    run = run_steps(df, [Step("auto_clean", {"drop_columns_above_threshold": False})], report="counts")
    found = {r["issue_type"]: (r["column"], r["severity"], r["count"]) for r in run.reports[1].table_issues.collect()}
    assert found["mostly_null_column"] == ("part_id", "critical", 95) and found["duplicate_rows"][1:] == ("critical", 94)
    run.release()


def test_a_held_source_has_the_same_digest(spark, source, tmp_path):
    """A table, or a part of it, that another run holds in memory hides its files from the plan that runs."""
    read = lambda: spark.read.parquet(source).filter("k > 1")
    before, versions = source_digest(read()), Versions(spark, str(tmp_path / "versions"))
    run_versioned(read(), PLAN, versions)
    held = read().persist()
    held.count()
    try:
        assert source_digest(read()) == before
        assert run_versioned(read(), PLAN, versions).reused == [1, 2, 3]
        with pytest.raises(ValueError, match="not read from files"):
            source_digest(spark.range(3))
    finally:
        held.unpersist()
