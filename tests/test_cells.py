import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import audit, cells, facts
from millrace.operators.causes import in_words, step_causes
from millrace.plans.clean_auto import auto_clean
from millrace.plans.clean_layers import run_layers
from millrace.plans.clean_smart import smart_clean
from millrace.plans.runner import Step, run_steps
from millrace.sources.scan import from_records

from .conftest import rows

CELL = st.one_of(
    st.integers(-(10**18), 10**18), st.booleans(), st.text(max_size=6), st.floats(allow_nan=False, allow_infinity=False),
    st.decimals(-1000, 1000, places=3).map(float), st.sampled_from(["1", "true", "1.0", "null", '"x"', "[1]", " 7 "]),
    st.lists(st.integers(0, 9), max_size=2), st.dictionaries(st.sampled_from("ab"), st.integers(0, 9), max_size=2), st.none(),
)


def mixed(spark, values):
    text = [(i, None if v is None else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(text, "_row_id bigint, j string").select("_row_id", F.parse_json("j").alias("v"))


def typed_cells(df):
    return [tuple(r) for r in df.select("_row_id", F.to_json("v"), F.schema_of_variant("v")).orderBy("_row_id").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(CELL, min_size=1, max_size=60))
def test_cells_come_back_as_they_were(spark, values):
    df = mixed(spark, values)
    assert typed_cells(cells.joined(cells.split(df), ["v"])) == typed_cells(df)


def test_changed_and_filled_cells(spark):
    df = mixed(spark, ["thirty", 28, "28", None, None, None, True])
    new = F.when(F.col("_row_id") == 0, "30").when(F.col("_row_id") == 1, "x").when(F.col("_row_id") == 3, "5").when(
        F.col("_row_id") == 4, "none"
    ).when(F.col("_row_id") == 6, "false").otherwise(F.col("v"))
    got = typed_cells(cells.typed(df, lambda d: d.withColumn("v", new)))
    assert [g[1] for g in got] == ['"30"', '"x"', '"28"', "5", '"none"', None, "false"]


def test_equal_texts_of_other_types_are_no_copies(spark):
    records = [{"g": 1, "v": v} for v in (1, "1", True, "true", 1, "1", None, None)] + [{"g": 2, "v": "a"}]
    df = from_records(spark, records)
    assert facts.duplicate_count(df).first()[0] == 3
    run = run_steps(df, [Step("remove_duplicates"), Step("fill_missing", {"column": "v", "method": "value", "value": "7"}), Step("sort_values", {"columns": ["v"]})])
    assert run.status == "success", run.error
    assert not [e for r in run.reports for e in r.errors]
    left = run.result.select("g", F.to_json("v")).collect()
    assert sorted(map(tuple, left)) == sorted([(1, "1"), (1, '"1"'), (1, "true"), (1, '"true"'), (1, "7"), (2, '"a"')])
    run.release()


def test_cleaners_keep_types(spark):
    records = [{"g": i, "note": v} for i, v in enumerate([" Yes ", 1, "1", True, "no", 2.5, "b", "c", " 1 "])]
    df = from_records(spark, records)
    for clean in (auto_clean, smart_clean, lambda d: run_layers(d, strict=True)):
        result = clean(df)
        got = {r.g: r.n for r in result.df.select("g", F.to_json("note").alias("n")).collect()}
        assert got[1] == "1" and got[2] == '"1"' and got[3] == "true" and got[5] == "2.5" and got[4] == '"no"'
        assert not [c for c in result.df.columns if c.startswith("_kind_of_")]
        result.release()


def test_empty_mixed_table(spark):
    df = mixed(spark, [1, "a"]).filter("_row_id < 0")
    assert typed_cells(cells.typed(df, lambda d: d)) == [] and facts.duplicate_count(df).first()[0] == 0


def test_audit_shows_a_change_of_type(spark):
    before, after = mixed(spark, [1, "1", True]), mixed(spark, ["1", "1", "x"])
    got = audit.audit_cells(before, after).select("_row_id", "action", "from", "to").orderBy("_row_id").collect()
    assert [tuple(r) for r in got] == [(0, "type_changed", "int", "string"), (2, "value_changed", "true", "x")]


# --- causes ---------------------------------------------------------------------------------
def facts_of(df):
    return {(r["code"], r["column"]): (r["rows"], r["examples"]) for r in df.collect()}


def test_filter_join_and_cast_causes(spark):
    left = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, "b"), (5, None), (6, "zz")], "_row_id int, k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("q", 4)], "k string, w int")
    got = facts_of(step_causes(left, "filter_rows", {"column": "k", "operator": "==", "value": "b"}))
    assert got == {("filter_missing", "k"): (1, []), ("filter_value", "k"): (3, [])}
    got = facts_of(step_causes(left, "join", {"on": "k"}, right))
    assert got[("left_alone", "k")] == (3, ["A ", "NULL", "zz"]) and got[("left_alone_folded", "k")] == (1, ["A "])
    assert got[("right_alone", "k")][0] == 1 and got[("repeated_both", "k")][0] == 4 and got[("largest_key", "k")][0] == 4
    got = facts_of(step_causes(left, "change_dtype", {"column": "k", "dtype": "int"}))
    assert got == {("cast_lost", "k"): (5, ["b", "A ", "a"])}


def test_other_causes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (1, "x"), (None, "x")], "a int, b string")
    assert facts_of(step_causes(df, "drop_missing", {})) == {("gap", "a"): (1, []), ("gap", "b"): (1, [])}
    assert facts_of(step_causes(df, "remove_duplicates", {})) == {("copies", "a, b"): (1, []), ("largest_group", "a, b"): (2, [])}
    assert facts_of(step_causes(df, "group_aggregate", {"group_by": ["a"]})) == {("missing_key", "a"): (1, []), ("groups", "a"): (1, [])}
    assert facts_of(step_causes(df, "sort_values", {"columns": ["a"]})) == {}
    none = df.filter("a > 5")
    for kind, config in (("filter_rows", {"column": "a", "value": 1}), ("join", {"on": "a"}), ("change_dtype", {"column": "b", "dtype": "int"}), ("remove_duplicates", {})):
        assert facts_of(step_causes(none, kind, config, none)) == {}
    assert in_words(step_causes(none, "drop_missing", {})).first()["causes"] == []


def test_a_run_says_which_rows_a_step_lost(spark):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"))
    run = run_steps(df, [Step("filter_rows", {"column": "x", "operator": ">", "value": 79})], report="counts")
    why = rows(run.reports[1].explanations.filter("anomaly_type = 'large_row_drop'"), "likely_cause")[0][0]
    assert "x: 50 rows, the cell is missing" in why and "x: 40 rows, the value does not pass" in why
    run.release()
