"""Indexed substring search gives the rows of a scan."""

import random

import pytest

from millrace.operators import catalog, substring

TEXTS = ["Traffic data of Bonn", "traffic DATA, hourly", "Bird songs", "", None, "ab", "İstanbul data", "x\n\ny data", "😀 smile 😀😀 data", "aaa", "aaaa bird"]
QUERIES = [
    "data", " Data ", "traffic AND data", "bird OR hourly", "ab", "ab AND traffic", "ab OR songs", "aaaa", "aaa", "zzz", "zzz AND data",
    "zzz OR bird", "😀😀", "\n\ny", "", "traffic and bonn AND of", "needle and other", "filler word 7",
]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(f"filler word {rng.randrange(60)}" for _ in range(rng.randrange(12))), "y") for i in range(300)]
    rows += [(1000, "z" * 70_000 + "needle" + "q" * 200_000 + " other", "long"), (1001, "needle" * 30_000, "long")]
    rows += [rows[0], (0, "songs under a used key", "x"), (None, "data without a key", "x"), (-5, "minus data", "x")]
    return spark.createDataFrame(rows, "id bigint, text string, k string").repartition(4)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return substring.build_index(table, "id", ["text"], str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_a_scan(table, index, query):
    found = index.search(table, query)
    assert found.columns == table.columns
    key = lambda r: (r.id is None, r.id or 0, r.text or "")
    assert sorted(found.collect(), key=key) == sorted(catalog.search(table, query, ["text"]).collect(), key=key)


def test_which_terms_go_through_the_index(index):
    assert index.candidates("ab") is None and index.candidates("bird OR ab") is None  # a short term decides
    assert index.candidates("filler") is None  # in nearly all entries
    assert {r.id for r in index.candidates("ab AND traffic").collect()} == {0, 1}
    assert {r.id for r in index.candidates("filler AND hourly").collect()} == {1}
    assert index.candidates("zzzz-not-there").count() == 0
    assert {r.id for r in index.candidates("needle").collect()} >= {1000, 1001}


def test_lists_are_bounded_and_pruned(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 64)
    monkeypatch.setattr(substring, "PIECE", 50)
    small = substring.build_index(table, "id", ["text"], str(tmp_path))
    assert small.postings.selectExpr("max(size(keys))").first()[0] <= 64
    assert small.postings.groupBy("run").count().agg({"count": "max"}).first()[0] > 1
    assert {r.id for r in small.search(table, "needle AND other").collect()} == {1000}
    plan = small._lists(["bir"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "run" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_new_build_replaces_the_old_one(spark, tmp_path):
    schema = "id bigint, a string, `b.c` string"
    empty = spark.createDataFrame([], schema)
    assert substring.build_index(empty, "id", ["a", "b.c"], str(tmp_path)).search(empty, "some").count() == 0
    two = spark.createDataFrame([(1, "left", "right"), (2, None, None)], schema)
    substring.build_index(two, "id", ["a", "b.c"], str(tmp_path))
    again = substring.open_index(spark, str(tmp_path))
    assert again.entries == 2 and [r.id for r in again.search(two, "ft ri").collect()] == [1]


def test_lists_hold_exactly_the_runs_of_the_texts(spark, table, index, tmp_path, monkeypatch):
    want = {}
    for r in table.where("id is not null").selectExpr("id", "lower(text) as text").collect():
        for run in substring.runs_of(r.text or ""):
            want.setdefault(run, set()).add(r.id)
    lists = lambda i: {(r.run, tuple(r["keys"]), r.n) for r in i.postings.collect()}
    got = {}
    for run, keys, n in lists(index):
        assert list(keys) == sorted(set(keys)) and n == len(keys)
        got.setdefault(run, []).extend(keys)
    assert {run: sorted(keys) for run, keys in got.items()} == {run: sorted(ids) for run, ids in want.items()}
    monkeypatch.setattr(substring, "PAIRS", 7)
    monkeypatch.setattr(substring, "PIECE", 50)
    few = substring.build_index(table.where("id < 900"), "id", ["text"], str(tmp_path))
    small = {run for run, ids in want.items() if any(i < 900 for i in ids)}
    assert {r for r, _, _ in lists(few)} == small


def test_a_task_sends_a_list_and_not_a_row_for_each_entry(spark):
    texts = spark.range(4000).selectExpr("id as k", "'some words' as piece").coalesce(1)
    sent = texts.mapInArrow(substring._listed(16), "run string, block bigint, keys array<bigint>")
    assert sent.selectExpr("count(*)", "sum(size(keys))").first() == (8, 32_000)
