"""Row ids of files: order of names and lines, one read of the text, no shuffle of the table."""

import json

import pytest

from millrace.rows import ROW_ID
from millrace.sources import scan


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "700")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _folder(tmp_path, lines):
    folder = tmp_path / "in"
    folder.mkdir()
    n = 0
    for name in ("b 2.csv", "a.csv", "c%20x.csv", "d.csv"):
        (folder / name).touch()
    for name in ("a.csv", "b 2.csv", "c%20x.csv", "d.csv"):
        body = "".join(f"{n + i},{'x' * (i % 7)}\n" for i in range(lines[name]))
        (folder / name).write_text("n,t\n" + body)
        n += lines[name]
    return str(folder), n


SIZES = {"a.csv": 900, "b 2.csv": 1, "c%20x.csv": 0, "d.csv": 2500}


def test_ids_follow_names_and_lines_in_many_splits(spark, tmp_path, tiny_splits):
    path, n = _folder(tmp_path, SIZES)
    df = scan.read_csv(spark, path, narrow=False)
    assert df.rdd.getNumPartitions() > 8
    assert [int(r["n"]) for r in df.orderBy(ROW_ID).collect()] == list(range(n))
    assert df.select(ROW_ID).distinct().count() == n


def test_order_does_not_depend_on_splits(spark, tmp_path):
    path, n = _folder(tmp_path, SIZES)
    assert [int(r["n"]) for r in scan.read_csv(spark, path, narrow=False).orderBy(ROW_ID).collect()] == list(range(n))


@pytest.mark.parametrize("listed", [scan.LISTED, 0])
def test_plan_reads_the_text_once_and_shuffles_no_rows(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(scan, "LISTED", listed)
    path, n = _folder(tmp_path, SIZES)
    df = scan.read_csv(spark, path, narrow=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "SortMergeJoin" not in plan
    assert "binaryFile" in plan and "content" not in plan.split("binaryFile", 1)[1].split("ReadSchema", 1)[1].split("\n")[0]
    above = plan.split("FileScan csv")[0]
    assert "BroadcastExchange" not in above  # the listing is the side that is copied
    assert [int(r["n"]) for r in df.orderBy(ROW_ID).collect()] == list(range(n))


def test_json_lines_and_parquet(spark, tmp_path, tiny_splits):
    folder = tmp_path / "json"
    folder.mkdir()
    for f in range(3):
        (folder / f"p{f}.json").write_text("".join(json.dumps({"n": 500 * f + i}) + "\n" for i in range(500)))
    got = scan.read_json(spark, str(folder)).orderBy(ROW_ID).collect()
    assert [r["n"] for r in got] == list(range(1500))
    spark.range(3000).repartition(3).write.parquet(str(tmp_path / "pq"))
    ids = scan.read_parquet(spark, str(tmp_path / "pq"))
    assert ids.select(ROW_ID).distinct().count() == 3000


def test_places_of_files_count_steps(spark, tmp_path):
    folder = tmp_path / "sizes"
    folder.mkdir()
    for name, size in (("a", 10), ("b", 0), ("c", 25)):
        (folder / name).write_bytes(b"x" * size)
    got = {r["_file"][-1]: r["_first"] for r in scan.file_places(spark, str(folder), 10).collect()}
    assert got["a"] == 0 and got["c"] - got.get("b", 2) in (0, 1) and got["c"] >= 2
