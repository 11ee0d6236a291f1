import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import issues, score
from millrace.plans import runner
from millrace.plans.clean_auto import auto_clean
from millrace.plans.clean_layers import run_layers
from millrace.plans.clean_smart import smart_clean
from millrace.plans.runner import Step
from millrace.sources import scan
from millrace.sources.registry import Registry, export, export_anomalies
from millrace.streaming.monitor import watch

from .conftest import rows

# Forty orders: id, customer, amount, quantity, status (c completed, p pending, x cancelled).
SALES = """1001 C001 1200 1 c;1002 C002 800.5 2 c;1003 C003 450 1 p;1004 C099 320 3 c;1005 C005 75 5 x;1006 C001 40 10 c
1007 C007 1200 2 c;1008 C888 800.5 1 p;1009 C009 450 3 c;1010 C010 320 2 c;1011 C002 150 4 c;1012 C012 90 6 x;1013 C013 1200 1 c
1014 C014 800.5 2 c;1015 C777 450 1 p;1016 C016 75 8 c;1017 C017 40 12 c;1018 C018 320 1 c;1019 C999 150 2 x;1020 C020 90 3 c
1021 C001 1200 1 c;1022 C002 800.5 1 c;1023 - 450 1 p;1024 C024 320 4 c;1025 C025 - 3 c;1026 C026 40 - x;1027 C027 1200 1 c
1028 C028 800.5 2 p;1029 C001 450 1 c;1030 C030 320 2 c;1031 C031 150 5 c;1032 C032 90 4 x;1033 C033 1200 1 c;1034 C034 800.5 3 c
1035 C035 450 2 p;1036 C036 75 6 c;1037 C037 40 9 c;1038 C038 320 1 c;1039 C039 150 3 c;1040 C040 90 2 x"""
CUSTOMERS = "1 2 3 5 7 9 10 12 13 14 16 17 18 20 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40".split()
# Staff: id, department, salary, age; three are listed twice.
STAFF = """E001 Engineering 95000 32;E002 Marketing 72000 28;E003 Engineering 105000 38;E004 HR 58000 25;E005 Engineering 98000 35
E006 Marketing 68000 27;E007 Finance 85000 31;E008 Engineering 92000 33;E009 HR 55000 24;E010 Finance 88000 30;E011 Engineering 110000 42
E012 Marketing 65000 26;E013 Engineering 97000 34;E014 HR 60000 26;E015 Finance 90000 29;E016 Engineering 93000 36;E017 Marketing 71000 28
E018 Engineering N/A 31;E019 HR 57000 25;E020 Finance 82000 30;E021 Engineering NOT_AVAILABLE 37;E022 Marketing 67000 27
E023 Engineering 96000 33;E024 HR 59000 24;E025 Finance 87000 31;E026 Engineering PENDING 29;E027 Marketing 70000 27
E028 Engineering 99000 35;E029 HR 56000 25;E030 Finance 84000 30;E001 Engineering 95000 32;E003 Engineering 105000 38;E011 Engineering 110000 42"""


def csv(folder, name, header, text, names=None):
    lines = [p.split() for line in text.splitlines() for p in line.split(";")]
    path = str(folder / f"{name}.csv")
    with open(path, "w") as f:
        f.write(header + "\n")
        for parts in lines:
            f.write(",".join("" if p == "-" else (names or {}).get(p, p) for p in parts) + "\n")
    return path


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    names = {"c": "completed", "p": "pending", "x": "cancelled"}
    path = csv(tmp_path_factory.mktemp("in"), "sales", "order_id,customer_id,amount,quantity,status", SALES, names)
    return path


@pytest.fixture(scope="module")
def staff(spark, tmp_path_factory):
    return csv(tmp_path_factory.mktemp("in"), "staff", "employee_id,department,salary,age", STAFF)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(f"C{int(n):03d}", f"name {n}") for n in CUSTOMERS], "customer_id string, customer_name string")


def plan_a(right):
    return [
        Step("filter_rows", {"column": "status", "operator": "==", "value": "completed"}, "completed"),
        Step("join", {"right_dataset": right, "on": "customer_id", "how": "inner"}, "customers"),
        Step("add_computed_column", {"new_column": "revenue", "operation": "multiply", "col_a": "amount", "col_b": "quantity"}, "revenue"),
        Step("sort_values", {"columns": ["revenue"], "ascending": False}, "sort"),
    ]


def test_scan_narrows_types(spark, sales, staff):
    assert dict(scan.read_csv(spark, sales).drop("_row_id").dtypes) == {
        "order_id": "bigint", "customer_id": "string", "amount": "double", "quantity": "bigint", "status": "string",
    }
    df = scan.read_csv(spark, staff)
    assert dict(df.dtypes)["salary"] == "string"
    assert df.filter("salary IS NULL").count() == 1


def test_scenario_a(spark, sales, customers):
    run = runner.run_steps(scan.read_csv(spark, sales), plan_a(customers), report="diff")
    assert run.status == "success", run.error
    trend = rows(run.row_trend(), "step_index", "row_count", "row_delta_pct")
    assert trend == [(0, 40, None), (1, 28, -30.0), (2, 27, -3.57), (3, 27, 0.0), (4, 27, 0.0)]
    found = rows(run.anomalies().filter("type = 'large_row_drop'"), "step_index", "severity", "value")
    assert found == [(1, "warning", -30.0)]
    revenue = [r.revenue for r in run.result.collect()]
    assert revenue[-1] is None and len(revenue) == 27
    assert sum(r for r in revenue if r is not None) == 24164.0 and revenue[0] == 2401.5
    why = run.reports[1].explanations.filter("anomaly_type = 'large_row_drop'").first()
    assert why["confidence"] == "high" and why["recommended_checks"] == ["rows: 40 to 28", "duplicate rows: 0 to 0"]
    assert "status" in why["likely_cause"]


def test_scenario_b(spark, staff):
    plan = [
        Step("change_dtype", {"column": "salary", "dtype": "float"}),
        Step("remove_duplicates", {"keep": "first"}),
        Step("fill_missing", {"column": "salary", "method": "mean"}),
        Step("group_aggregate", {"group_by": ["department"], "aggregations": {"salary": "mean", "age": "mean"}}),
    ]
    df = scan.read_csv(spark, staff)
    assert runner.build(df, plan[:1]).filter("salary IS NULL").count() == 3
    assert runner.build(df, plan[:2]).count() == 30
    got = {r.department: (round(r.salary, 4), round(r.age, 4)) for r in runner.build(df, plan).collect()}
    assert got == {
        "Engineering": (93740.7407, 34.5833), "Finance": (86000.0, 30.1667), "HR": (57500.0, 24.8333),
        "Marketing": (68833.3333, 27.1667),
    }


def test_failed_step_keeps_the_reports_before(spark, sales):
    plan = [Step("filter_rows", {"column": "status", "operator": "notnull"}), Step("sort_values", {"columns": ["zz"]})]
    run = runner.run_steps(scan.read_csv(spark, sales), plan, report="counts")
    assert run.status == "failed" and "zz" in run.error and len(run.reports) == 2
    with pytest.raises(ValueError, match="unknown step type"):
        runner.apply_step(run.result, Step("explode"))


def test_order_is_renewed_for_steps_that_need_it(spark, sales):
    plan = [
        Step("sort_values", {"columns": ["amount"], "ascending": False}),
        Step("remove_duplicates", {"columns": ["status"], "keep": "first"}),
    ]
    got = dict(rows(runner.build(scan.read_csv(spark, sales), plan), "status", "amount"))
    assert got == {"completed": 1200.0, "pending": 800.5, "cancelled": 150.0}


def test_editing_a_list_of_steps():
    a, b = Step("auto_clean"), Step("smart_clean")
    plan = runner.add_step(runner.add_step([], a), b, at=0)
    assert [s.step_type for s in plan] == ["smart_clean", "auto_clean"]
    plan = runner.reorder_steps(plan, [a.step_id, b.step_id])
    plan = runner.edit_step(plan, b.step_id, enabled=False)
    assert plan == [a, Step("smart_clean", {}, "", False, b.step_id)]
    assert runner.delete_step(plan, a.step_id) == plan[1:]
    assert Step.from_json(plan[1].to_json()) == plan[1]


def test_full_reports_registry_and_exports(spark, sales, customers, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    people = str(tmp_path / "people.parquet")
    customers.write.parquet(people)
    df = registry.register("sales", sales)
    registry.register("people", people)
    assert {r.name for r in registry.datasets().collect()} == {"sales", "people"}
    plan = plan_a("people")[:2]
    run = runner.run_steps(df, plan, registry.lookup, on_step=registry.save_snapshot)
    assert run.status == "success", run.error
    registry.save_run(run, plan)
    assert registry.runs().first()["status"] == "success"
    assert [r.row_count for r in registry.snapshots(run.run_id).collect()] == [40, 28, 27]
    report = run.reports[1]
    assert report.errors == [] and report.audit.count() == 0
    assert 0 <= report.score.first()["after_cleaning"] <= 100
    assert runner.affected_columns(plan[0], df) == ["status"]
    export_anomalies(run, str(tmp_path / "anomalies"))
    kept = [json.loads(x) for p in (tmp_path / "anomalies").glob("*.json") for x in open(p)]
    assert [k["step_index"] for k in kept] == [0, 1, 2]
    assert [len(k.get("anomalies", [])) > 0 for k in kept] == [False, True, False] and kept[1]["explanations"][0]["likely_cause"]
    dated = run.result.withColumn("day", F.to_date(F.lit("2024-01-05")))
    export(dated, str(tmp_path / "csv"), ordered=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 27 and back.first()["day"] == "2024-01-05" and "_row_id" not in back.columns


def test_csv_round_trip_of_rows_in_order(spark, sales):
    df = scan.read_csv(spark, sales)
    assert [r.order_id for r in scan.preview(df, 3).collect()] == [1001, 1002, 1003]
    with pytest.raises(ValueError, match="empty"):
        scan.require_rows(df.limit(0))


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2, "b": "x"}]))
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    for name in ("a.json", "b.jsonl"):
        assert rows(scan.read_json(spark, str(tmp_path / name)), "a", "b") == [(1, None), (2, "x")]


def test_records_with_mixed_cells(spark):
    df = scan.from_records(spark, [{"age": "thirty", "n": 1}, {"age": 28, "n": 2.5}, {"salary": "£45,000"}])
    types = dict(df.dtypes)
    assert (types["age"], types["n"], types["salary"]) == ("variant", "double", "string")
    kinds = df.select(F.schema_of_variant("age")).collect()
    assert [k[0] for k in kinds] == ["STRING", "BIGINT", None]
    assert [r.age for r in scan.variant_to_text(df).orderBy("_row_id").collect()] == ["thirty", "28", None]


def test_parquet_row_ids_follow_files(spark, tmp_path):
    spark.range(0, 100, numPartitions=4).write.parquet(str(tmp_path / "t"))
    got = scan.read_parquet(spark, str(tmp_path / "t")).orderBy("_row_id")
    assert [r.id for r in got.collect()] == list(range(100))


def test_cleaners_on_staff(spark, staff):
    df = scan.read_csv(spark, staff)
    smart = smart_clean(df)
    assert smart.roles["age_columns"] == ["age"] and smart.roles["salary_columns"] == ["salary"]
    assert smart.df.count() == 30 and smart.df.filter("salary IS NULL").count() == 0
    assert smart.summary().first()["dupes_removed"] == 3
    none = smart_clean(df, {r: [] for r in smart.roles})
    assert dict(none.df.dtypes)["salary"] == "string"
    auto = auto_clean(df)
    assert auto.types["salary"] == "numeric" and auto.df.count() == 33
    layered = run_layers(df, layers=["profiling", "schema_inference", "normalization", "validation", "repair", "duplicate_handling"])
    assert layered.errors == [] and layered.df.count() == 30
    assert layered.schema["salary"]["semantic"] == "money"
    skipped = run_layers(df, layers=["normalization", "schema_inference"])
    assert skipped.layers_run == ["normalization"]


def test_substring_names_are_an_option(spark):
    df = spark.createDataFrame([("M001", 1), ("M002", 2)], "manager_id string, region int")
    assert smart_clean(df.withColumn("_row_id", F.col("region"))).roles["age_columns"] == []
    odd = smart_clean(df.withColumn("_row_id", F.col("region")), match="substring")
    assert odd.roles["age_columns"] == ["manager_id"]


def test_score_bounds_and_identity_diff(spark, staff):
    from millrace.operators.anomalies import compute_diff, detect_anomalies

    df = scan.read_csv(spark, staff)
    found = issues.issue_table(spark, issues.layer_issues(df))
    many = found.crossJoin(spark.range(40)).drop("id")
    assert score.quality_score(df, many).first()["score"] == 0.0
    assert 0 < score.quality_score(df, found).first()["score"] < 100
    assert detect_anomalies(compute_diff(df, df)).count() == 0


def test_stream_batches_run_the_same_steps(spark, sales, tmp_path):
    df = scan.read_csv(spark, sales)
    folder = str(tmp_path / "in")
    df.drop("_row_id").write.parquet(folder)
    seen = []

    def write(result, facts, batch_id):
        seen.append((result.count(), facts.filter("column = 'amount'").first()["num_count"]))

    stream = spark.readStream.schema(df.drop("_row_id").schema).parquet(folder)
    plan = [Step("filter_rows", {"column": "status", "operator": "==", "value": "completed"})]
    query = watch(stream, plan, write, key="order_id").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == [(28, 27)]
    assert os.path.isdir(tmp_path / "state")
